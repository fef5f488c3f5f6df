"""License scan: phrases, and an exact set-similarity join of text blocks with templates.

Native: DataFrame functions only.  A block is a window over the words of a text, whatever line
breaks, comment signs or marks lie between them: windows of twice a size begin at every
multiple of the size, so that any run of so many words lies within one of them whole.  There
are windows of a few sizes, and each template is held against those of the smallest size that
has room for it.  A block meets a template if it holds a share of 0.8 or more of the template's
different words, all words that tell this license from others like it, and none that tell of
another.

The join orders words by how many documents hold them, the rarest first.  A block that meets a
template of n words, k of them at least, must hold one of the template's first n - k + 1 words
(prefix filter) and have k words (length filter), and behind the first word that both have,
enough words must be left on either side (positional filter).  What passes is counted exactly,
so every block over the threshold is found.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Words of a window's step; a template is looked for in windows of the first size that is not smaller.
SIZES = (16, 64, 256)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
)
_MIT_REST = (
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_REST = (
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
#: Texts of common licenses and of their notices, with the label, words that must be there too, and words that must not.
TEMPLATES: dict[str, tuple[str, str, str]] = {
    "released under the mit license": ("mit", "mit", ""),
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit", "", ""),
    _MIT: ("mit", "", ""),
    f"{_MIT} {_MIT_REST}": ("mit", "", ""),
    "licensed under the apache license version 2 0": ("apache", "apache", ""),
    "you may not use this file except in compliance with the license": ("apache", "compliance", ""),
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license": ("apache", "apache", ""),
    "licensed under the gnu general public license version 3": ("gpl", "gnu general", "lesser affero"),
    "this program is free software you can redistribute it and or modify it": ("gpl", "redistribute", "lesser affero"),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version 3 of the license or at your option any later version "
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
    "or fitness for a particular purpose see the gnu general public license for more details "
    "you should have received a copy of the gnu general public license along with this program": ("gpl", "gnu general", "lesser affero"),
    "under the terms of the gnu lesser general public license as published by the free software foundation": ("lgpl", "lesser", ""),
    "under the terms of the gnu affero general public license as published by the free software foundation": ("agpl", "affero", ""),
    "this work is licensed under a creative commons attribution 4 0 international license": ("cc-by", "attribution", "noncommercial sharealike noderivatives"),
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": ("cc-by-nc", "noncommercial", ""),
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": ("cc-by-sa", "sharealike", "noncommercial"),
    "licensed under cc by 4 0": ("cc-by", "cc", "nc sa nd"),
    "licensed under cc by nc 4 0": ("cc-by-nc", "cc nc", ""),
    _BSD: ("bsd", "", ""),
    f"{_BSD} {_BSD_REST}": ("bsd", "", ""),
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": ("isc", "fee", ""),
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
    "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications "
    "and to alter it and redistribute it freely subject to the following restrictions": ("zlib", "alter", ""),
    "subject to the terms of the mozilla public license v 2 0": ("mpl", "mozilla", ""),
    "this is free and unencumbered software released into the public domain": ("unlicense", "unencumbered", ""),
}
CONTAINMENT = 0.8
#: Everything but digits, a-z and what lies outside of ASCII.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(text: Column) -> Column:
    """The words of a lower-cased text, each with a space before it, and one after the last; no word: one space."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(text, F.lit(" ")), GAP, " ")))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase in spaced words, and the first and last word it starts at (null if none)."""
    parts = F.split(words, f" {phrase}(?= )", -1)
    n = F.size(parts) - 1
    first = F.when(n > 0, spaces(F.get(parts, F.lit(0))))
    last = F.when(n > 0, spaces(words) - 1 - (spaces(F.element_at(parts, -1)) - 1) - len(phrase.split()))
    return n, first, last


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of the templates: one row a word comes back."""
    words = F.split(spaced_words(lowered(F.col("text"))), " ")
    held = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def size_of(n_words: int) -> int:
    """The size of the windows that a template of so many words is looked for in; one that no window is sure to hold is an error."""
    if n_words > SIZES[-1]:
        raise ValueError(f"a template has {n_words} words; at most {SIZES[-1]} are found wherever they stand")
    return next(x for x in SIZES if n_words <= x)


def template_rows(templates: dict[str, tuple[str, str, str]], frequency: dict[str, int], containment: float) -> list[tuple]:
    """(template, size, label, words rarest first, needed, words that must be there, words that must not) of each template."""
    rows = []
    for text, (label, must, never) in sorted(templates.items()):
        words = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        rows.append((text, size_of(len(text.split())), label, words, ceil(containment * len(words) - 1e-9), must.split(), never.split()))
    return rows


def windows(words: Column, size: int, some: Column) -> Column:
    """The windows of a size over an array of words that hold one of some words, as sets: (of, block)."""

    def over(all_words: Column) -> Column:
        begins = F.sequence(F.lit(0), F.floor((F.size(all_words) - 1) / size).cast("int"))
        cut = lambda i: F.slice(all_words, i * size + 1, F.lit(2 * size))
        held = F.filter(begins, lambda i: F.arrays_overlap(cut(i), some))
        return F.transform(held, lambda i: F.struct(F.lit(size).alias("of"), F.array_distinct(cut(i)).alias("block")))

    # as a variable of an outer function the words are made once, not once for each window
    return F.get(F.transform(F.array(words), over), F.lit(0))


def scan(docs: DataFrame, keep: list[str] | None = None, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """docs (text, ...) as (row, n_words, n_base, first_word, last_word, base_labels, labels, score).

    base_labels and labels are sorted arrays.  score: 1 where a phrase stands, else the
    greatest containment of a template met, else 0.  Null and empty texts have no words; texts of
    any length are scanned whole, in windows.  Repeated rows are scanned one by one; columns of
    docs may have any names; an empty table gives an empty one.  templates: text to (label,
    words that must be there, words that must not), of as many words as the largest window's step.
    """
    columns = docs.columns if keep is None else keep
    spark = docs.sparkSession
    vocabulary = sorted({w for t, (_, must, never) in templates.items() for w in f"{t} {must} {never}".split()})
    frequency = word_frequencies(docs.select("text").filter("text is not null"), vocabulary)
    rows = template_rows(templates, frequency, containment)
    prefix_of = lambda row: row[3][: len(row[3]) - row[4] + 1]
    prefixes = {x: sorted({w for r in rows if r[1] == x for w in prefix_of(r)}) for x in sorted({r[1] for r in rows})}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}

    text = lowered(text_or_empty())
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text.alias("low"))
    slim = slim.select("row", "low", spaced_words(F.col("low")).alias("words"))
    n_words = spaces(F.col("words")) - 1
    out = {"row": F.col("row"), "n_words": n_words.cast("long")}
    found = {}
    for phrase, label in phrases.items():
        # every word of the phrase must be somewhere in the text before places are looked for
        maybe = F.contains(F.col("words"), F.lit(f" {phrase} "))
        found[label] = [F.when(maybe, x) for x in phrase_places(F.col("words"), phrase)]
    count = [F.coalesce(x[0], F.lit(0)) for x in found.values()]
    out["n_base"] = sum(count[1:], count[0]).cast("long")
    firsts, lasts = ([x[i] for x in found.values()] for i in (1, 2))
    out["first_word"] = (F.least(*firsts) if len(firsts) > 1 else firsts[0]).cast("long")
    out["last_word"] = (F.greatest(*lasts) if len(lasts) > 1 else lasts[0]).cast("long")
    out["base_labels"] = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (label, n) in zip(found, count, strict=True)]))))
    # windows with a word of some prefix, as sets of words
    literal = lambda words: F.array(*map(F.lit, words))
    every = F.split(F.trim("words"), " ")
    slim = slim.withColumn("seen", F.array_intersect(every, literal(sorted({w for x in prefixes.values() for w in x}))))
    none = F.array().cast("array<struct<of:int,block:array<string>>>")
    out["blocks"] = F.concat(*[F.when(F.arrays_overlap("seen", literal(words)), windows(every, size, literal(words))).otherwise(none) for size, words in prefixes.items()])
    base = slim.select(*[c.alias(k) for k, c in out.items()])
    base = materialize(base.withColumn("rid", F.monotonically_increasing_id()), "license-base")

    # the join: a block's words that templates know, rarest first, against the prefixes
    order = literal(sorted(vocabulary, key=rank.get))
    block = base.select("rid", F.posexplode("blocks").alias("number", "x"))
    block = block.select("rid", "number", "x.of", F.size("x.block").alias("size"), F.array_intersect(order, F.col("x.block")).alias("known"))
    token = block.select("rid", "number", "of", "size", "known", F.posexplode("known").alias("place", "token"))
    prefix_rows = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], i, w) for r in rows for i, w in enumerate(prefix_of(r))]
    table = spark.createDataFrame(prefix_rows, "template string, step int, label string, target array<string>, needed int, must array<string>, never array<string>, at int, prefix string")
    met = token.join(F.broadcast(table), (F.col("token") == F.col("prefix")) & (F.col("of") == F.col("step")))  # as many rows as the templates have prefixes
    met = met.filter(F.col("size") >= F.col("needed"))
    met = met.groupBy("rid", "number", "template").agg(F.min(F.struct("place", "at", "known", "label", "target", "needed", "must", "never")).alias("first")).select("rid", "first.*")
    met = met.filter((F.size(F.array_except("must", "known")) == 0) & ~F.arrays_overlap("never", "known"))
    behind = F.least(F.size("target") - F.col("at"), F.size("known") - F.col("place"))  # both from the first common word on
    shared = F.size(F.array_intersect("known", "target"))
    met = met.filter(behind >= F.col("needed")).filter(shared >= F.col("needed"))
    labels = met.groupBy(F.col("rid").alias("of")).agg(F.collect_set("label").alias("more"), F.max(shared / F.size("target")).alias("contained"))
    joined = base.drop("blocks").join(labels, F.col("rid") == F.col("of"), "left")
    both = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0)))
    return joined.select("row", "n_words", "n_base", "first_word", "last_word", "base_labels", both.alias("labels"), score.alias("score"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    found = scan(documents(spark, sf_dir), keep=["doc_id"])
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def _sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS start FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    templates = ", ".join(f"('{label}', {size_of(len(t.split()))}, {sorted(set(t.split()))}, {must.split()}::VARCHAR[], {never.split()}::VARCHAR[])" for t, (label, must, never) in TEMPLATES.items())
    sizes = ", ".join(f"({x})" for x in SIZES)
    return f"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
places AS ({places}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         list_sort(list_distinct(list(label))) AS base_labels
  FROM places GROUP BY doc_id),
templates(label, size, words, must, never) AS (VALUES {templates}),
sizes(size) AS (VALUES {sizes}),
blocks AS (
  SELECT doc_id, size, list_distinct(w[i * size + 1 : i * size + 2 * size]) AS b
  FROM (SELECT doc_id, w, size, unnest(range(0, (len(w) + size - 1) // size)) AS i FROM worded, sizes)),
met AS (
  SELECT doc_id, label, len(list_intersect(b, words))::DOUBLE / len(words) AS contained FROM blocks JOIN templates USING (size)
  WHERE len(list_intersect(b, words)) >= ceil({CONTAINMENT} * len(words) - 1e-9) AND list_has_all(b, must) AND NOT list_has_any(b, never)),
more AS (
  SELECT doc_id, list_distinct(list(label)) AS more, max(contained) AS contained FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(contained, 0.0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP6_SQL = _sql()
