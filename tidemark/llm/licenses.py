"""Licence scans by a positional index of rare words, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates by label: the first phrase is mandatory, the others raise the score.
TEMPLATES = {
    "agpl": ["affero general public license", "gnu"],
    "apache": ["apache license", "licensed under the apache license", "version 2 0"],
    "bsd": ["redistribution and use in source and binary forms", "with or without modification", "this list of conditions"],
    "bsl": ["boost software license", "version 1 0"],
    "cc-by": ["cc by", "licensed under", "4 0"],
    "cc-by-nc": ["cc by nc", "licensed under", "4 0"],
    "cc-by-nd": ["cc by nd", "licensed under", "4 0"],
    "cc-by-sa": ["cc by sa", "licensed under", "4 0"],
    "cc0": ["cc0 1 0", "public domain dedication"],
    "epl": ["eclipse public license", "v 2 0"],
    "gpl": ["general public license", "gnu", "this work is licensed under", "version 3"],
    "isc": ["permission to use copy modify and or distribute this software", "isc license"],
    "lgpl": ["lesser general public license", "gnu"],
    "mit": ["mit license", "released under the mit license", "permission is hereby granted free of charge"],
    "mpl": ["mozilla public license", "version 2 0"],
    "reserved": ["all rights reserved"],
    "unlicense": ["free and unencumbered software released into the public domain"],
}


def vocabulary(templates: dict[str, list[str]]) -> list[str]:
    return sorted({w for ps in templates.values() for p in ps for w in p.split()})


def document_frequencies(words: DataFrame, templates: dict[str, list[str]]) -> dict[str, int]:
    """In how many documents of words(w array<string>) each licence word stands, over all of them."""
    hit = words.select(F.explode(F.array_intersect("w", F.array(*map(F.lit, vocabulary(templates))))).alias("word"))
    return {r["word"]: r["n"] for r in hit.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _less(n: int):
    return lambda x: x - n


def _starts(places: Column, phrase: str, rarity: dict[str, int]) -> Column:
    """Starts of a phrase: postings of its words, rarest first, each moved back by its place in the phrase, intersected."""
    words = sorted(enumerate(phrase.split()), key=lambda x: (rarity.get(x[1], 0), x[0]))
    out = None
    for i, w in words:
        moved = F.transform(F.coalesce(places.getItem(w), F.array().cast("array<int>")), _less(i))
        out = moved if out is None else F.array_intersect(out, moved)
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text, ...).

    Words are taken from the whole text with A-Z lower-cased. n_base counts the places of the base phrases; first_word
    and last_word are the smallest and largest start of one, null without any. base_labels are the labels of base
    phrases found, labels also those of templates whose mandatory phrase is found; both distinct, sorted, comma-joined
    (empty: none). score is the largest share of a found label's phrases that stand in the text, else 0.

    Only texts that hold the rarest word of some mandatory phrase are looked up further: their licence words' positions
    form posting lists, which are intersected by relative position, rarest word first by document frequency over docs.
    Null text counts as empty; a null doc_id stays; repeated rows stay; an empty table gives an empty result.
    """
    templates = templates or TEMPLATES
    words = docs.select("doc_id", F.regexp_extract_all(ascii_lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
    rarity = document_frequencies(words, templates)
    anchors = sorted({min(p.split(), key=lambda w: (rarity.get(w, 0), w)) for p in [*BASE, *(t[0] for t in templates.values())]})
    lit = lambda x: F.array(*map(F.lit, x))
    known = lit(vocabulary(templates | {"": list(BASE)}))
    hits = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(known, x), F.struct(x.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    looked = words.select("doc_id", F.size("w").alias("n_words"), F.when(F.arrays_overlap("w", lit(anchors)), hits).alias("hits"))
    some = F.coalesce("hits", F.array().cast("array<struct<w:string,i:int>>"))
    names = F.array_distinct(F.transform(some, lambda h: h["w"]))
    postings = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(some, lambda h: h["w"] == n), lambda h: h["i"])))
    placed = looked.select("doc_id", "n_words", F.when(F.col("hits").isNotNull(), postings).alias("p"))
    phrases = sorted({p for t in templates.values() for p in t} | set(BASE))
    found = F.struct(*[_starts(F.col("p"), p, rarity).alias(f"p{i}") for i, p in enumerate(phrases)])
    at = {p: f"f.p{i}" for i, p in enumerate(phrases)}
    placed = placed.select("doc_id", "n_words", F.when(F.col("p").isNotNull(), found).alias("f"))
    has = lambda p: F.coalesce(F.size(at[p]) > 0, F.lit(False))
    base = F.when(F.col("f").isNotNull(), F.concat(*[F.col(at[p]) for p in BASE])).otherwise(F.array().cast("array<int>"))
    label = lambda pairs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(has(p), F.lit(n)) for n, p in pairs])))), ",")
    basic = [(n, p) for p, n in BASE.items()]
    score = F.greatest(F.lit(0.0), *[F.when(has(t[0]), sum((has(p).cast("int") for p in t[1:]), F.lit(1)) / len(t)).otherwise(0.0) for t in templates.values()])
    return placed.withColumn("b", base).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("b").cast("long").alias("n_base"), F.array_min("b").cast("long").alias("first_word"), F.array_max("b").cast("long").alias("last_word"),
        label(basic).alias("base_labels"), label(basic + [(n, t[0]) for n, t in templates.items()]).alias("labels"), score.cast("double").alias("score"),
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL: phrases are searched in the space-joined words."""
    line = "' ' || array_to_string(w, ' ') || ' '"
    here = lambda p: f"contains(line, ' {p} ')"
    places = "list_concat(" + ", ".join(f"list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r})" for p in BASE) + ")"
    label = lambda pairs: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {here(p)} THEN '{n}' END" for n, p in pairs) + "], lambda x: x IS NOT NULL))), ',')"
    basic = [(n, p) for p, n in BASE.items()]
    score = ", ".join(f"CASE WHEN {here(t[0])} THEN ({' + '.join(['1', *(f'CAST({here(p)} AS INT)' for p in t[1:])])}) / {len(t)}::DOUBLE ELSE 0.0 END" for t in TEMPLATES.values())
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
u AS (SELECT *, {line} AS line, {places} AS b FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word,
 {label(basic)} AS base_labels, {label(basic + [(n, t[0]) for n, t in TEMPLATES.items()])} AS labels, greatest(0.0, {score})::DOUBLE AS score FROM u"""
