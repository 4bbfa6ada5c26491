"""Reports on nested opinions against their SQL twins, with one comment of 2,500 opinions."""

import os

import pytest

from echolens.plans import catalog
from echolens.plans.tables import BASE, with_views

from .twins import connect, differences

FOLDER, MANY = "/root/testdata/sf0.001", 2500


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    con = connect(FOLDER)
    comment = con.execute(with_views("SELECT min(id) FROM vf WHERE platform = 'steam'")).fetchone()[0]
    for name in BASE:
        if name != "conversations":
            os.symlink(f"{FOLDER}/{name}.parquet", f"{folder}/{name}.parquet")
    con.execute(f"""
        COPY (SELECT * FROM conversations WHERE conv_id <> {comment}
              UNION ALL BY NAME SELECT CAST({comment} AS BIGINT) AS conv_id, CAST(range AS INT) AS turn, 'user' AS role, 'q' || range AS text FROM range({MANY}))
        TO '{folder}/conversations.parquet'""")
    return folder, comment


@pytest.mark.parametrize("name", ["a34_nested_opinions", "s9_voice_documents"])
def test_a_comment_of_many_opinions_is_one_row(name, hot, spark):
    folder, comment = hot
    df = catalog.queries()[name](spark, folder)
    assert df.filter(f"{'comment_id' if name.startswith('a34') else 'id'} = {comment}").count() == 1
    assert differences(df, connect(folder), catalog.oracle_sql()[name]) == []
