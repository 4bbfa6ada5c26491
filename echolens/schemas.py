"""Table schemas (ingest records, comments, opinions, vectors, bullet comments)."""

COMMENTS = """
    id bigint, platform string, source_id string, target_id string, content string, author string,
    author_id string, rating int, language string, likes int, replies int, posted_at timestamp_ntz,
    extra_json string, extra_meta string, sentiment string, sentiment_score double,
    sentiment_confidence double, topic string, sub_topics array<string>, fetched_at timestamp_ntz,
    likes_refreshed_at timestamp_ntz, developer_response_refreshed_at timestamp_ntz, analyzed_at timestamp_ntz
"""

RAW_COMMENTS = """
    platform string, source_id string, target_key string, content string, author string, author_id string,
    rating int, language string, likes int, replies int, posted_at timestamp_ntz, extra_json string
"""

OPINIONS = """
    id bigint, comment_id bigint, full_path string, sentiment string, sentiment_confidence double,
    quote string, quote_start int, quote_end int, created_at timestamp_ntz
"""

EMBEDDINGS = "comment_id bigint, model string, dim int, vector array<float>, created_at timestamp_ntz"

DANMAKU = """
    id bigint, video_id string, cid string, content string, progress int, mode int, color int,
    user_hash string, posted_at timestamp_ntz, fetched_at timestamp_ntz
"""

REVIEW_JSON = """
    recommendationid string, timestamp_created bigint, voted_up boolean, review string, language string,
    votes_up int, comment_count int, steam_purchase boolean, received_for_free boolean, refunded boolean,
    written_during_early_access boolean, primarily_steam_deck boolean, weighted_vote_score double,
    app_release_date bigint, reactions array<string>, developer_response string, timestamp_dev_responded bigint,
    author struct<steamid: string, playtime_forever: bigint, playtime_at_review: bigint,
                  playtime_last_two_weeks: bigint, deck_playtime_at_review: bigint>
"""

REPLY_JSON = """
    rpid bigint, ctime bigint, `like` int, rcount int, content struct<message: string>,
    member struct<mid: string, uname: string, sex: string, level_info: struct<current_level: int>,
                  vip: struct<status: int>, official_verify: struct<title: string>>
"""

MODEL_RESPONSE = """
    results array<struct<index: variant, sentiment: string, sentiment_score: string, opinions: array<struct<
        phrase: string, sentiment: string, sentiment_score: string, sentiment_confidence: string,
        is_core: boolean>>>>
"""

REVIEW_EXTRAS = """
    appid string, playtime_at_review bigint, playtime_forever bigint, refunded boolean,
    written_during_early_access boolean, primarily_steam_deck boolean, received_for_free boolean,
    weighted_vote_score double, developer_response string
"""
