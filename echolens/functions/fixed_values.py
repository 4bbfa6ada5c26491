"""Labels and word lists that decide results, so they are stated exactly."""

META_L1 = "综合与元表达"
RECOMMEND_LABEL = "综合推荐度"
OVERALL_LABEL = "总体体验评价"
MEME_LABEL = "网络梗与段子"
FALLBACK_LABELS = "综合推荐度 总体体验评价 评测区排版·字符画 网络梗与段子 反讽·阴阳怪气表达".split()

MEME_WORDS = """
    坟头草 玩梗 整活 乐子 抽象 典中典 绷不住了 蚌埠住了 流汗黄豆 梗小鬼 整蛊 乐死 沙雕 表情包 段子 发癫 逆天
    村里 第一个大学生 第二个大学生 第一个研究生 大吉大利 星星眼
""".split()
PRAISE_WORDS = """
    好玩 神作 太棒了 推荐 不错 好评 绝了 神 yyds nb NB 牛 史诗 天花板 经典 完美
    love god perfect great amazing awesome nice good excellent best
""".split()
CRITICIZE_WORDS = """
    垃圾 烂 粪作 毁我 差评 不行 拉胯 糟糕 烂作 拉 答辩 trash shit worst bad terrible awful
""".split()
RECOMMEND_WORDS = "推荐 值不值得 值得买 值不值 必买 千万别买 非常值得 出必买 值得一玩 年度最佳".split()
MASKED_TERMS = "卡总 卡大厅".split()
MASK = "×"
SHORT_PHRASE = 20

SENTIMENTS = ("positive", "negative", "neutral")
RATING_TIERS = [(95, "好评如潮"), (90, "特别好评"), (80, "好评"), (70, "多半好评"), (40, "褒贬不一"), (20, "多半差评")]
LOWEST_TIER = "差评"
STORE_RATINGS = {1: "差评", 2: "差评", 3: "褒贬不一", 4: "褒贬不一", 5: "褒贬不一",
                 6: "好评", 7: "好评", 8: "特别好评", 9: "好评如潮"}
NO_STORE_RATING = "无"

# Chart word list.
CHART_STOPWORDS = """
    的 了 是 在 和 与 及 或 也 就 都 还 但 而 反 而且 这 那 这个 那个 这些 那些 一个 一些 什么 怎么 为什么
    我 你 他 她 它 我们 你们 他们 它们 不 没 没有 不太 不很 不是 不算 很 太 真 真的 非常 特别 比较 觉得 感觉 一直
    上 下 里 外 前 后 中 内 能 会 可以 应该 需要 啊 吧 呢 嗯 哦 哈 哈哈 呵呵 嘻嘻 就是 就是说 反正 然后 那么 因为 所以 因此
    对 对于 关于 按照 通过 自己 各 每 所有 全部 大部分 把 被 让 给 向 从 到
    steam 游戏 这游戏 这作 这个游戏 一点 一样 下次 上次 一开始
""".split()
# Per-target word list; only words of two or more characters can be met there.
TARGET_STOPWORDS = """
    这个 那个 这样 那样 什么 怎么 为什么 可以 能够 应该 觉得 认为 感觉 知道 看到 听到 现在 以前 以后 之后 之前 时候 地方
    一些 一点 一直 一下 一起 一样 一定 游戏 就是 真的 比较 非常 特别 而且 但是 所以 因为 由于 如果 虽然 尽管 不过 只是
    一个 那种 自己 最后 然后 已经 问题 很多 确实
""".split()
