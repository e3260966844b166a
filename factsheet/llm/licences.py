"""Licence recognition by sentence rules.

A text is cut into paragraphs at blank lines, comment marks at the start of lines are dropped, and each paragraph
is read twice: line by line, as licences are named in running text, and with its lines joined, as headers
are wrapped. The reading with more known sentences counts (then the one with fewer unknown ones, then that by
lines). Sentences that speak of licences are normalised and mapped to known sentence identifiers, and
the text's sequence of identifiers is matched against ordered rules: a rule takes its identifiers out of
the sequence, so longer and more special rules stand first. Sentences that speak of a licence and are not known
are counted.

Defined cases: null and empty texts, and texts without such a sentence, have no licence; equal rows get
equal results; repeated sentences name their licence once; empty tables give empty results; other
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.llm.common import picked
from factsheet.llm.quality import let

#: Comment marks at the start of a line, what parts paragraphs, and line breaks inside one.
MARKS = r"(?m)^[ \t]*(/\*+|\*+/?|//+|#+|--+|;+|%+)[ \t]*"
BLANK = r"\r?\n[ \t\r]*\n\s*"
BREAK = r"[ \t\r]*\n[ \t]*"
#: What ends a sentence: its sign behind a letter, digit, bracket or quote, then white space.
END = r"([\p{L}\p{N})\"'][.!?])[ \t]+"
#: Words of sentences that speak of licences.
CUE = r"(?i)licen[sc]e|copyright|\(c\) ?[0-9]|spdx|permission is hereby|warrant(y|ies)|rights reserved|redistribut|public domain|merchantab"
UNKNOWN = "?"
_THING = r"(this|the) (work|program|library|file|software|code|document|project|package|text)"
_UNDER = rf"({_THING} is )?(distributed|licensed|released|available|provided|published|made available)"
#: (identifier, pattern of the whole normalised sentence); the first that fits counts.
SENTENCES = (
    ("spdx_apache2", r"spdx license identifier apache 2\.0"),
    ("spdx_mit", r"spdx license identifier mit"),
    ("spdx_gpl2", r"spdx license identifier gpl 2\.0( only| or later)?"),
    ("spdx_gpl3", r"spdx license identifier gpl 3\.0( only| or later)?"),
    ("spdx_bsd3", r"spdx license identifier bsd 3 clause"),
    ("apache2", rf"{_UNDER} under (the )?apache license,? (version )?2(\.0)?( the license)?"),
    ("apache_copy", r"you may obtain a copy of the license at.*"),
    ("apache_use", r"you may not use this file except in compliance with the license"),
    ("mit", rf"{_UNDER} under (the )?(terms of the )?mit license"),
    ("mit_name", r"(the )?mit license( mit)?"),
    ("mit_grant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included.*"),
    ("as_is", r"the software is provided as is,? without warranty of any kind.*"),
    ("bsd_grant", r"redistribution and use in source and binary forms.*permitted.*"),
    ("bsd_source", r".*redistributions of source code must retain.*"),
    ("bsd_binary", r".*redistributions in binary form must reproduce.*"),
    ("bsd_name", r".*neither the name of .* may be used to endorse.*"),
    ("gpl3", rf"{_UNDER} under (the )?(terms of the )?gnu general public license,? version 3(\.0)?"),
    ("gpl2", rf"{_UNDER} under (the )?(terms of the )?gnu general public license,? version 2(\.0)?"),
    ("lgpl", rf"{_UNDER} under (the )?(terms of the )?gnu lesser general public license.*"),
    ("agpl", rf"{_UNDER} under (the )?(terms of the )?gnu affero general public license.*"),
    ("gpl", rf"{_UNDER} under (the )?(terms of the )?gnu general public license"),
    ("agpl_free", r"(.* )?free software,? you can redistribute it.*affero general public license.*"),
    ("lgpl_free", r"(.* )?free software,? you can redistribute it.*(lesser|library) general public license.*"),
    ("gpl3_free", r"(.* )?free software,? you can redistribute it.*general public license.*version 3 .*"),
    ("gpl2_free", r"(.* )?free software,? you can redistribute it.*general public license.*version 2 .*"),
    ("gpl_free", r"(.* )?free software,? you can redistribute it.*general public license.*"),
    ("gpl_warranty", r"(.* )?is distributed in the hope that it will be useful.*"),
    ("gpl_received", r"you should have received a copy of the gnu .*general public license.*"),
    ("mpl2", rf"{_UNDER} under (the )?mozilla public license,? (version |v\. ?)?2(\.0)?"),
    ("mpl2_terms", r"this source code form is subject to the terms of the mozilla public license.*"),
    ("cc_by_nc_nd", rf"{_UNDER} under (a |the )?(cc|creative commons)( license)? by nc nd( [0-9.]+)?.*"),
    ("cc_by_nc_sa", rf"{_UNDER} under (a |the )?(cc|creative commons)( license)? by nc sa( [0-9.]+)?.*"),
    ("cc_by_nc", rf"{_UNDER} under (a |the )?(cc|creative commons)( license)? by nc( [0-9.]+)?"),
    ("cc_by_sa", rf"{_UNDER} under (a |the )?(cc|creative commons)( license)? by sa( [0-9.]+)?"),
    ("cc_by", rf"{_UNDER} under (a |the )?(cc|creative commons)( license)? by( [0-9.]+)?"),
    ("cc0", r".*(cc0|dedicated to the public domain|released into the public domain).*"),
    ("rights", r"(.* )?all rights reserved"),
    ("copyright", r"(.* )?(copyright|c) (c )?([0-9]{4}.*|by .*)"),
)
#: (licence, pattern over the sequence of identifiers, each ended by a semicolon); in order.
RULES = (
    ("Apache-2.0", r"(spdx_apache2;)?apache2;(apache_use;)?(apache_copy;)?|spdx_apache2;"),
    ("MIT", r"(mit_name;)?(copyright;)?mit_grant;(mit_notice;)?(as_is;)?|spdx_mit;(mit;)?|mit;(as_is;)?|mit_name;"),
    ("BSD-3-Clause", r"bsd_grant;bsd_source;bsd_binary;bsd_name;(as_is;)?|spdx_bsd3;"),
    ("BSD-2-Clause", r"bsd_grant;bsd_source;bsd_binary;(as_is;)?"),
    ("AGPL", r"(agpl;|agpl_free;)(gpl_warranty;)?(gpl_received;)?"),
    ("LGPL", r"(lgpl;|lgpl_free;)(gpl_warranty;)?(gpl_received;)?"),
    ("GPL-3.0", r"((spdx_gpl3;)?(gpl3;|gpl3_free;)|spdx_gpl3;(gpl_free;)?)(gpl_warranty;)?(gpl_received;)?"),
    ("GPL-2.0", r"((spdx_gpl2;)?(gpl2;|gpl2_free;)|spdx_gpl2;(gpl_free;)?)(gpl_warranty;)?(gpl_received;)?"),
    ("GPL", r"(gpl;|gpl_free;)(gpl_warranty;)?(gpl_received;)?"),
    ("MPL-2.0", r"mpl2;|mpl2_terms;"),
    ("CC-BY-NC-ND", r"cc_by_nc_nd;"),
    ("CC-BY-NC-SA", r"cc_by_nc_sa;"),
    ("CC-BY-NC", r"cc_by_nc;"),
    ("CC-BY-SA", r"cc_by_sa;"),
    ("CC-BY", r"cc_by;"),
    ("CC0", r"cc0;"),
    ("Proprietary", r"(copyright;)?rights;"),
)


def bounded(pattern: str) -> str:
    """A rule's pattern at the start of a sequence or behind another identifier."""
    return f"(^|;)({pattern})"


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, licences (sorted array), sentences (identifiers in order, array), n_unknown."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"))
    cued = F.when(F.col("text").rlike(CUE), F.col("text"))
    paragraphs = F.filter(F.split(F.regexp_replace(cued, MARKS, ""), BLANK), lambda p: p.rlike(CUE))

    def normal(s):
        s = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}.,]+", " ")
        return F.regexp_replace(F.regexp_replace(s, r"^[ .,]+|[ .,]+$", ""), r" +", " ")

    def known(s):
        name = F.when(F.lit(False), F.lit(""))
        for identifier, pattern in SENTENCES:
            name = name.when(s.rlike(f"^({pattern})$"), identifier)
        return name.otherwise(UNKNOWN)

    def identifiers(p):
        sentences = F.filter(F.split(F.regexp_replace(p, END, "$1\n"), "\n"), lambda s: s.rlike(CUE))
        return F.transform(sentences, lambda s: let(normal(s), known))

    def unknown(found):
        return F.size(F.filter(found, lambda s: s == UNKNOWN))

    def better(lines, joined):
        n, m = F.size(lines) - unknown(lines), F.size(joined) - unknown(joined)
        return F.when((m > n) | ((m == n) & (unknown(joined) < unknown(lines))), joined).otherwise(lines)

    def read(p):
        whole = let(identifiers(F.regexp_replace(p, BREAK, " ")), lambda joined: let(identifiers(p), lambda lines: better(lines, joined)))
        return F.when(p.contains("\n"), whole).otherwise(identifiers(p))

    found = F.coalesce(F.flatten(F.transform(paragraphs, read)), F.array().cast("array<string>"))
    rows = rows.select("doc_id", found.alias("all"))
    rows = rows.select("doc_id", F.filter("all", lambda s: s != UNKNOWN).alias("sentences"), F.size(F.filter("all", lambda s: s == UNKNOWN)).cast("bigint").alias("n_unknown"))
    # The sequence begins with a semicolon, and each rule leaves one where it took identifiers out.
    rows = rows.withColumn("rest", F.concat(F.lit(";"), F.array_join(F.transform("sentences", lambda s: F.concat(s, F.lit(";"))), "")))
    found = []
    for k, (licence, pattern) in enumerate(RULES):
        rows = rows.withColumn(f"r{k}", F.col("rest").rlike(bounded(pattern))).withColumn("rest", F.regexp_replace("rest", bounded(pattern), ";"))
        found.append(F.when(F.col(f"r{k}"), F.lit(licence)))
    return rows.select("doc_id", F.sort_array(F.array_compact(F.array(*found))).alias("licences"), "sentences", "n_unknown")


def licences_sql() -> str:
    """The same in DuckDB's SQL, over ``documents``; arrays are joined by commas."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cases = " ".join(f"when regexp_full_match(s, {quoted(p)}, 's') then {quoted(i)}" for i, p in SENTENCES)

    def identifiers(p: str) -> str:
        cut = f"string_split(regexp_replace({p}, {quoted(END)}, '\\1' || chr(10), 'g'), chr(10))"
        normal = r"regexp_replace(regexp_replace(regexp_replace(lower(s), '[^\p{L}\p{N}.,]+', ' ', 'g'), '^[ .,]+|[ .,]+$', '', 'g'), ' +', ' ', 'g')"
        listed = f"list_transform(list_filter({cut}, lambda s: regexp_matches(s, {quoted(CUE)})), lambda s: {normal})"
        return f"list_transform({listed}, lambda s: case {cases} else '?' end)"

    def count(found: str, sign: str) -> str:
        return f"len(list_filter({found}, lambda s: s {sign} '?'))"

    joined = f"regexp_replace(p, {quoted(BREAK)}, ' ', 'g')"
    more = f"{count('b', '<>')} > {count('a', '<>')} or {count('b', '<>')} = {count('a', '<>')} and {count('b', '=')} < {count('a', '=')}"
    steps, at = [], "q"
    for k, (_, pattern) in enumerate(RULES):
        steps.append(f"q{k} as (select * exclude rest, regexp_matches(rest, {quoted(bounded(pattern))}) as r{k}, regexp_replace(rest, {quoted(bounded(pattern))}, ';', 'g') as rest from {at})")
        at = f"q{k}"
    names = ", ".join(f"case when r{k} then {quoted(licence)} end" for k, (licence, _) in enumerate(RULES))
    return rf"""
with s as (
    select doc_id, list_filter(regexp_split_to_array(regexp_replace(case when regexp_matches(text, {quoted(CUE)}) then text end, {quoted(MARKS)}, '', 'g'), {quoted(BLANK)}),
        lambda p: regexp_matches(p, {quoted(CUE)})) as l from documents
), e as (
    select doc_id, i, l[i] as p from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from s)
), r as (
    select doc_id, i, {identifiers("p")} as a, {identifiers(joined)} as b from e
), c as (
    select doc_id, flatten(list(case when {more} then b else a end order by i)) as l from r group by doc_id
), i as (
    select documents.doc_id, coalesce(c.l, []) as l from documents left join c using (doc_id)
), q as (
    select doc_id, list_filter(l, lambda s: s <> '?') as ids, len(list_filter(l, lambda s: s = '?')) as n_unknown,
        ';' || coalesce(array_to_string(list_transform(list_filter(l, lambda s: s <> '?'), lambda s: s || ';'), ''), '') as rest from i
), {", ".join(steps)}
select doc_id, coalesce(array_to_string(list_sort(list_filter([{names}], lambda s: s is not null)), ','), '') as licences,
    coalesce(array_to_string(ids, ','), '') as sentences, n_unknown
from {at}
"""
