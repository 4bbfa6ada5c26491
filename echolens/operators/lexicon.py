"""Topic dictionary: taxonomy leaves and keywords, held as a configuration of checked size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as fixed
from .dictionary import KeyIndex, WordIndex

MAX_LEAVES = 10_000
MAX_KEYWORDS = 50_000


@dataclass(frozen=True)
class Lexicon:
    """``taxonomy``: (ord, l1, l2, l3, is_fallback); ``keywords``: (l3, keyword, pos), duplicates kept."""

    taxonomy: tuple[tuple[int, str, str, str, bool], ...]
    keywords: tuple[tuple[str, str, int], ...]
    meme_words: tuple[str, ...] = tuple(fixed.MEME_WORDS)
    recommend_words: tuple[str, ...] = tuple(fixed.RECOMMEND_WORDS)
    praise_words: tuple[str, ...] = tuple(fixed.PRAISE_WORDS)
    criticize_words: tuple[str, ...] = tuple(fixed.CRITICIZE_WORDS)
    masked_terms: tuple[str, ...] = tuple(fixed.MASKED_TERMS)
    meme_label: str = fixed.MEME_LABEL
    recommend_label: str = fixed.RECOMMEND_LABEL
    overall_label: str = fixed.OVERALL_LABEL
    meta_l1: str = fixed.META_L1
    fallback: frozenset[str] = field(init=False)

    def __post_init__(self):
        if len(self.taxonomy) > MAX_LEAVES or len(self.keywords) > MAX_KEYWORDS:
            raise ValueError("the dictionary is sent to every task; split it or raise the limits knowingly")
        object.__setattr__(self, "fallback", frozenset(t[3] for t in self.taxonomy if t[4]))

    @property
    def overall_words(self) -> tuple[str, ...]:
        return self.praise_words + self.criticize_words

    def taxonomy_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.taxonomy), "ord int, l1 string, l2 string, l3 string, is_fallback boolean")

    def path_index(self) -> KeyIndex:
        """Label to full path; a label that holds a slash already carries its second level."""
        return KeyIndex({l3: f"{l1}/{l3}" if "/" in l3 else f"{l1}/{l2}/{l3}" for _, l1, l2, l3, _ in reversed(self.taxonomy)})

    def keywords_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.keywords), "l3 string, keyword string, pos int")

    def competing(self) -> list[tuple[str, dict[str, int]]]:
        """Labels that compete by keyword, in dictionary order, each with the weight of its words.

        A word's weight is its length, counted once per time the dictionary lists it.
        """
        weights: dict[str, dict[str, int]] = {}
        for l3, word, _ in self.keywords:
            if l3 not in self.fallback and word:
                of_label = weights.setdefault(l3, {})
                of_label[word] = of_label.get(word, 0) + len(word)
        ords = {t[3]: t[0] for t in self.taxonomy}
        # A label outside the taxonomy comes after those inside, in the order met.
        return sorted(weights.items(), key=lambda item: ords.get(item[0], MAX_LEAVES))

    def label_index(self) -> WordIndex:
        """Competing words, each with the labels it speaks for and its weight there."""
        points: dict[str, list[dict]] = {}
        for rank, (_, words) in enumerate(self.competing()):
            for word, weight in words.items():
                points.setdefault(word, []).append({"rank": rank, "weight": weight})
        return WordIndex(points, "array<struct<rank: int, weight: int>>")

    def entry_index(self) -> WordIndex:
        """Competing words, each with its dictionary entries."""
        entries: dict[str, list[dict]] = {}
        for l3, word, pos in self.keywords:
            if l3 not in self.fallback and word:
                entries.setdefault(word, []).append({"l3": l3, "keyword": word, "pos": pos})
        return WordIndex(entries, "array<struct<l3: string, keyword: string, pos: int>>")
