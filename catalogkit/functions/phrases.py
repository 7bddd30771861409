"""Conversion of script by phrases: the longest phrase at each place, from left to right, else the single character.

``phrases`` (src, dst) and ``characters`` (src, dst) are tables of data.  They are dictionaries of a language, whose size is
checked before they are given to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 5_000_000  # characters of all entries


class Trie:
    """Phrases by their characters; a node is a dict, its value stands under the empty key."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.root: dict = {}
        for src, dst in pairs:
            node = self.root
            for c in src:
                node = node.setdefault(c, {})
            node[""] = dst

    def convert(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, end, found = self.root, at, None
            while end < len(text) and text[end] in node:
                node, end = node[text[end]], end + 1
                if "" in node:
                    found = end, node[""]
            if found:
                at = found[0]
                out.append(found[1])
            else:
                out.append(text[at])
                at += 1
        return "".join(out)


def converter(phrases: DataFrame, characters: DataFrame | None = None):
    """A function of a text column.  Of a phrase that repeats the smallest dst counts; a phrase goes before a character of
    the same text; entries without src or dst are left out, and null texts stay null."""
    table = phrases.select("src", "dst", F.lit(0).alias("level"))
    table = table.unionByName(characters.select("src", "dst", F.lit(1).alias("level"))) if characters is not None else table
    table = table.where("src <> '' AND dst IS NOT NULL").groupBy("src").agg(F.min(F.struct("level", "dst"))["dst"].alias("dst"))
    size = table.agg(F.sum(F.length("src") + F.length("dst"))).first()[0] or 0
    if size > MOST:
        raise ValueError(f"the dictionary holds {size} characters; {MOST} at most are given to every task")
    shared = phrases.sparkSession.sparkContext.broadcast([tuple(r) for r in table.collect()])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(shared.value)
        for batch in batches:
            yield batch.map(trie.convert, na_action="ignore")

    return lambda c: run(c if isinstance(c, Column) else F.col(c))
