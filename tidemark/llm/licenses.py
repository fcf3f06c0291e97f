"""Licence scans over a positional rare-token index, in DataFrame functions only.

Templates are notices and declarations of licences; each holds a mandatory key
phrase. The index is made once for all of them: the words of all templates are
counted over the corpus, each key phrase is posted under its ``RARE`` words of highest
IDF, and a posting names the phrase and the word's place in it. A file is read once,
whatever the number of templates: its own words of highest IDF, those that have
postings, are looked up where they stand; every posting gives the start that the phrase
would have there, starts that the postings of all rare words agree on are candidates,
and the whole key phrase is verified at those. A template's score is the share of
its words that stand where they should around a verified key phrase.

Null and empty texts have no words, no places, empty labels and score 0. Every
row is scanned by itself, whole; repeated rows give repeated results, an empty
table none. Ids may have any type and be null. A task holds the words of one text as
an array. Columns besides the named ones are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base contract: phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    key: str
    text: str

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        key, words = self.key_words, self.words
        return next(k for k in range(len(words)) if words[k : k + len(key)] == key)


#: The method's own labels: declarations in a line, and the notices of files; each text holds its key phrase.
TEMPLATES = [
    Template("gpl-3.0", "gnu general public license", "licensed under the gnu general public license version 3"),
    Template("gpl-3.0", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl-2.0", "gnu general public license", "licensed under the gnu general public license version 2"),
    Template("gpl-2.0", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit-release", "mit license", "released under the mit license"),
    Template("mit-notice", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("isc", "distribute this software for any purpose with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("bsd-3-clause", "endorse or promote products derived from this software", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("epl-2.0", "eclipse public license", "made available under the terms of the eclipse public license 2 0"),
    Template("cddl", "common development and distribution license", "subject to the terms of the common development and distribution license"),
    Template("unlicense", "released into the public domain", "free and unencumbered software released into the public domain"),
    Template("cc0", "waived all copyright and related or neighboring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by-4.0", "cc by", "licensed under cc by 4 0"),
    Template("cc-by-4.0", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa-4.0", "creative commons attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc-4.0", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("zlib", "in no event will the authors be held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    Template("artistic-2.0", "artistic license", "under the terms of the artistic license 2 0"),
    Template("eupl-1.2", "european union public licence", "licensed under the european union public licence 1 2"),
    Template("ofl-1.1", "sil open font license", "licensed under the sil open font license version 1 1"),
    Template("sspl-1.0", "server side public license", "under the terms of the server side public license version 1"),
    Template("ms-pl", "microsoft public license", "licensed under the microsoft public license"),
]
#: Share of a template's words that must stand in place.
ACCEPT = 0.8
#: Words of a key phrase whose postings must agree.
RARE = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are in no word.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: A candidate is the number of its phrase and its start in one long.
_PHRASE = 1 << 32


def phrases(templates: list[Template] = TEMPLATES) -> list[str]:
    """All key phrases, those of the base contract first."""
    return list(dict.fromkeys([*BASE_PHRASES, *(t.key for t in templates)]))


def _words(text: Column) -> Column:
    """The words in lower case, split at single spaces, for which no pattern is run."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def document_frequencies(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of a template or key phrase stands, over all of ``docs``; as many rows as there are such words."""
    words = sorted({w for x in [*phrases(templates), *(t.text for t in templates)] for w in x.split()})
    seen = F.array_distinct(F.filter(_words(F.col(text)), lambda w: w.isin(words)))
    counted = docs.select(F.explode(seen).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(words, 0) | {r["word"]: r["n"] for r in counted.collect()}


def rare_words(phrase: str, frequency: dict[str, int], rare: int = RARE) -> list[tuple[str, int]]:
    """The phrase's words of highest IDF with their places; ties by place."""
    words = phrase.split()
    order = sorted(range(len(words)), key=lambda k: (frequency.get(words[k], 0), k))
    return [(words[k], k) for k in order[:rare]]


def postings(kinds: list[str], frequency: dict[str, int], rare: int = RARE) -> list[dict[str, list[dict]]]:
    """For the rarest words of all phrases, the second rarest and so on: word to [(phrase p, place o)]; a phrase of fewer words repeats its last."""
    out: list[dict[str, list[dict]]] = [{} for _ in range(rare)]
    for p, phrase in enumerate(kinds):
        own = rare_words(phrase, frequency, rare)
        for k in range(rare):
            word, place = own[min(k, len(own) - 1)]
            out[k].setdefault(word, []).append({"p": p, "o": place})
    return out


def _constant(value: object, kind: str) -> Column:
    """A literal of a nested type; the optimizer reads its text once, when it folds constants."""
    return F.from_json(F.lit(json.dumps(value)), kind) if kind.startswith(("map", "array<struct")) else F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id", accept: float = ACCEPT, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    kinds = phrases(templates)
    index = postings(kinds, document_frequencies(docs, text, templates))
    tokens = sorted({w for post in index for w in post})
    lists = [_constant(post, "map<string,array<struct<p:long,o:int>>>") for post in index]
    expected = _constant([p.split() for p in kinds], "array<array<string>>")
    names = _constant(list(BASE_PHRASES.values()), "array<string>")
    holders = [[{"label": t.label, "at": t.key_at, "words": t.words} for t in templates if t.key == p] for p in kinds]
    around = _constant(holders, "array<array<struct<label:string,at:int,words:array<string>>>>")
    phrase = lambda c: F.floor(c / _PHRASE).cast("int")
    start = lambda c: (c % _PHRASE).cast("int")

    def starts(words: Column, places: Column, post: Column) -> Column:
        """Candidates by the postings of the words at ``places``."""
        by_place = lambda i: F.transform(F.filter(F.element_at(post, words[i]), lambda x: x["o"] <= i), lambda x: x["p"] * _PHRASE + i - x["o"])
        return F.flatten(F.filter(F.transform(places, by_place), lambda x: x.isNotNull()))

    def share(words: Column, first: Column, t: Column) -> Column:
        in_place = F.transform(t["words"], lambda w, k: F.coalesce((F.get(words, first - t["at"] + k) == w).cast("int"), F.lit(0)))
        return F.aggregate(in_place, F.lit(0), lambda a, b: a + b) / F.size(t["words"]).cast("double")

    def looked_up(words: Column) -> Column:
        places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(tokens), i)))
        agreed = starts(words, places, lists[0])
        for post in lists[1:]:
            agreed = F.array_intersect(agreed, starts(words, places, post))
        verified = F.filter(agreed, lambda c: F.slice(words, start(c) + 1, F.size(expected[phrase(c)])) == expected[phrase(c)])
        return F.struct(words.alias("w"), verified.alias("at"))

    def result(x: Column) -> Column:
        base = F.filter(x["at"], lambda c: phrase(c) < len(BASE_PHRASES))
        places = F.transform(base, start)
        base_names = F.transform(base, lambda c: names[phrase(c)])
        scored = F.flatten(F.transform(x["at"], lambda c: F.transform(around[phrase(c)], lambda t: F.struct(t["label"].alias("label"), share(x["w"], start(c), t).alias("share")))))
        own = F.transform(F.filter(scored, lambda s: s["share"] >= accept), lambda s: s["label"])
        joined = lambda some: F.array_join(F.array_sort(F.array_distinct(some)), ",")
        return F.struct(F.size(x["w"]).cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), joined(base_names).alias("base_labels"), joined(F.concat(base_names, own)).alias("labels"), F.coalesce(F.array_max(F.transform(scored, lambda s: s["share"])), F.lit(0.0)).alias("score"))

    # one-element arrays bind the words and then the places once for all that use them
    found = F.transform(F.transform(F.array(_words(F.col(text))), looked_up), result)[0]
    return docs.select(F.col(id_column).alias("doc_id"), found.alias("r")).select("doc_id", "r.*")


def scan_sql(documents: str = "documents", accept: float = ACCEPT) -> str:
    """DuckDB SQL for ``scan``: every place compared, without an index."""
    text = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lists = ", ".join(f"list_filter(range(0, len(w)), lambda i: w[i + 1] = '{p.split()[0]}' AND w[i + 1 : i + {len(p.split())}] = [{', '.join(f"'{x}'" for x in p.split())}]) AS p{k}" for k, p in enumerate(phrases()))
    number = {p: k for k, p in enumerate(phrases())}
    base = " || ".join(f"p{number[p]}" for p in BASE_PHRASES)
    names = ", ".join(f"CASE WHEN len(p{number[p]}) > 0 THEN '{label}' END" for p, label in BASE_PHRASES.items())

    def share(t: Template) -> str:
        return f"coalesce(list_max(list_transform(p{number[t.key]}, lambda s: ({' + '.join(f"CASE WHEN s + {k - t.key_at} >= 0 AND w[s + {k - t.key_at} + 1] = '{x}' THEN 1 ELSE 0 END" for k, x in enumerate(t.words))}) / {float(len(t.words))})), 0.0)"

    shares = ", ".join(f"{share(t)} AS s{k}" for k, t in enumerate(TEMPLATES))
    own = ", ".join(f"CASE WHEN s{k} >= {accept} THEN '{t.label}' END" for k, t in enumerate(TEMPLATES))
    join = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda y: y IS NOT NULL))), ','), '')"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{text}') AS w FROM {documents}),
p AS (SELECT doc_id, w, {lists} FROM t),
s AS (SELECT *, {base} AS b, {shares} FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word,
 {join(names)} AS base_labels, {join(names + ", " + own)} AS labels, greatest({", ".join(f"s{k}" for k in range(len(TEMPLATES)))})::DOUBLE AS score
FROM s"""
