"""Configuration files: taxonomy, dictionary and monitored targets. All are small and read on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fixed
from ..operators.lexicon import Lexicon


def read_config(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML configuration needs PyYAML; JSON works without it") from error
    return yaml.safe_load(text) or {}


def taxonomy_rows(config: dict, fallback: list[str] | None = None) -> list[tuple[int, str, str, str, bool]]:
    """The ``hierarchy`` tree flattened in order; a later duplicate of a leaf replaces the earlier one."""
    general = set(fixed.FALLBACK_LABELS if fallback is None else fallback)
    leaves: dict[str, tuple[str, str]] = {}
    for l1, seconds in (config.get("hierarchy") or {}).items():
        for l2, words in (seconds.items() if isinstance(seconds, dict) else ()):
            for l3 in words if isinstance(words, list) else ():
                leaves[l3] = (l1, l2)
    return [(i, l1, l2, l3, l3 in general) for i, (l3, (l1, l2)) in enumerate(leaves.items())]


def keyword_rows(config: dict) -> list[tuple[str, str, int]]:
    """Keywords of each label plus its own name; a name listed as keyword counts twice."""
    rows = []
    for l3, item in (config.get("definitions") or {}).items():
        words = [w for w in [*((item or {}).get("keywords") or []), l3] if w]
        rows += [(l3, w, pos) for pos, w in enumerate(words)]
    return rows


def load_lexicon(taxonomy_path: str, definitions_path: str, **options) -> Lexicon:
    """The dictionary order decides ties, so labels are numbered as the definitions list them."""
    keywords = keyword_rows(read_config(definitions_path))
    order = {l3: i for i, l3 in enumerate(dict.fromkeys(k[0] for k in keywords))}
    tree = taxonomy_rows(read_config(taxonomy_path), options.pop("fallback", None))
    ranked = [(order.get(l3, len(order) + i), l1, l2, l3, fb) for i, l1, l2, l3, fb in tree]
    return Lexicon(tuple(ranked), tuple(keywords), **options)


def target_rows(spark: SparkSession, config: dict) -> DataFrame:
    """Enabled targets in file order; a missing flag means enabled."""
    rows = [
        (i, t["platform"], str(t["id"]), t.get("name"), t.get("language"), t.get("count"), t.get("enabled"))
        for i, t in enumerate(config.get("targets") or [])
    ]
    schema = "ord int, platform string, key string, name string, language string, count int, enabled boolean"
    return enabled_targets(spark.createDataFrame(rows, schema))


def enabled_targets(targets: DataFrame) -> DataFrame:
    return targets.filter(F.coalesce("enabled", F.lit(True))).withColumn(
        "target_id", F.concat_ws(":", "platform", "key"))
