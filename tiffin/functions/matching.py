"""Which of many words occur in a text, in one pass over it.

``contains`` per word reads a text once per word. Here an automaton of all words
reads each text of an Arrow batch once and answers with one bit per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of one automaton: the bits of a long that are safe for signed arithmetic.
WORDS_PER_MASK = 62


def _mask_udf(words: list[str]):
    @F.pandas_udf("bigint")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for bit, word in enumerate(words):
            automaton.add_word(word, 1 << bit)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([None if t is None else sum({bit for _, bit in automaton.iter(t)}) for t in texts], dtype="Int64")

    return mask


class WordMatcher:
    """Substring tests of a fixed word list against a text column, one scan for up to ``WORDS_PER_MASK`` words.

    ``masks(text)`` gives the columns to compute (name -> mask); the other methods read them. As with ``contains``, case
    matters, a word counts wherever it stands, inside another one too, and a null text gives null, an empty one no hit.
    """

    def __init__(self, words: list[str], prefix: str = "_hits"):
        self.words = list(dict.fromkeys(words))
        if "" in self.words:
            raise ValueError("an empty word is in every text")
        self.prefix = prefix

    def masks(self, text: Column) -> dict[str, Column]:
        blocks = [self.words[i:i + WORDS_PER_MASK] for i in range(0, len(self.words), WORDS_PER_MASK)]
        return {f"{self.prefix}{n}": _mask_udf(block)(text) for n, block in enumerate(blocks)}

    def has(self, word: str) -> Column:
        block, bit = divmod(self.words.index(word), WORDS_PER_MASK)
        return F.getbit(F.col(f"{self.prefix}{block}"), F.lit(bit)) == 1

    def count(self, words: list[str]) -> Column:
        return reduce(lambda a, w: a + self.has(w).cast("int"), words, F.lit(0))

    def any(self, words: list[str]) -> Column:
        return reduce(lambda a, w: a | self.has(w), words, F.lit(False))
