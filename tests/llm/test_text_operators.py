import hashlib
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factsheet.llm import decontaminate, language, licences, mixing, pii, quality, secrets
from tests.llm.fixtures import SCHEMA, odd_rows

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


# Decontamination


def containment(docs, items):
    out = set()
    for item, text in items:
        words = WORD.findall((text or "").lower())
        n = min(5, len(words))
        if not n:
            continue
        need = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        have = {}
        for doc, t in docs:
            w = WORD.findall((t or "").lower())
            have.setdefault(doc, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        out |= {(d, item, len(need & h), len(need)) for d, h in have.items() if len(need & h) / len(need) >= 0.8}
    return out


def test_contamination_equals_brute_force(spark, odd):
    docs = [(r[0], r[1]) for r in odd_rows()]
    base = docs[0][1].split()
    items = [(1, " ".join(base[10:40])), (2, " ".join(base[50:75])), (3, "One!"), (4, None), (5, ""), (1, " ".join(base[:30])), (6, "absent words here"), (None, " ".join(base[80:100])), (7, docs[11][1][:4000])]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, h long")
    found = decontaminate.contamination(odd, table).collect()
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in found)
    expected = Counter()
    for pair in items:
        expected.update(containment(docs, [pair]))
    assert got == expected and expected
    shuffled = decontaminate.contamination(odd, table, broadcast_rows=0).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in shuffled) == expected
    kept = decontaminate.decontaminate(odd, table)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in odd_rows()} - {d for d, *_ in expected}
    assert decontaminate.contamination(odd.limit(0), table).count() == 0
    assert decontaminate.contamination(odd, table.limit(0)).count() == 0 and decontaminate.decontaminate(odd, table.limit(0)).count() == odd.count()


# Personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_patterns(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            number = [int(c) for c in m.group() if c in "0123456789"]
            ok = kind == "email"
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m.group().split("."))
            if kind == "card":
                ok = 12 <= len(number) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(number[::-1])) % 10 == 0
            if kind == "phone":
                ok = 9 <= len(number) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "x@@y.zz", "@", "a@b", ".", "-", " ", "é", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+49 (30) 1234-567", "+1", "7", "\n", "%+@a-b.c"]), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert sorted(pii.base_spans(text)) == base_by_patterns(text)


def test_checksums_and_context():
    good, bad = "IBAN DE89 3704 0044 0532 0130 00 now", "IBAN DE89 3704 0044 0532 0130 01 now"
    assert [pii.KINDS[k] for _, k, _, _ in pii.spans(good)] == ["iban"] and pii.spans(bad) == []
    assert pii.spans("call +49 30 1234567")[0][3] > pii.spans("nothing +49 30 1234567")[0][3] > pii.spans("order +49 30 1234567")[0][3]


@pytest.mark.parametrize("number", ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"])
@pytest.mark.parametrize("behind", ["", " EUR", " BIC", " BANK", " EUR 100", " 2024 EUR", ".", " now", "x"])
def test_account_numbers_end_where_they_end(number, behind):
    text = f"Pay {number}{behind}"
    assert [(a, b) for a, k, b, _ in pii.spans(text) if pii.KINDS[k] == "iban"] == ([] if behind == "x" else [(4, 4 + len(number))])


def test_account_numbers_in_a_row_and_in_context():
    one, two = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034"
    assert [text_ for text_ in (f"{one} {two}"[a:b] for a, b in pii.ibans(f"{one} {two}"))] == [one, two]
    kinds = [[pii.KINDS[k] for _, k, _, _ in pii.spans(f"{left} {two}")] for left in ("see", "serial", "account, serial")]
    assert kinds == [["iban"], [], ["iban"]]


def test_personal_data_of_odd_rows(spark, odd):
    rows = [(1, "Mail é a@b.de or 10.0.0.1", 0), (2, None, 0), (None, "", 0), (1, "Mail é a@b.de or 10.0.0.1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    found = pii.find_personal_data(docs).collect()
    assert sorted(len(r.spans) for r in found) == [0, 0, 2, 2]
    assert [(s.kind, s.start, s.end) for r in found if r.spans for s in r.spans][:2] == [("email", 7, 13), ("ip", 17, 25)]
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(odd.limit(0)).count() == 0
    assert {r.text for r in pii.redact(docs).collect()} == {"Mail é <email> or <ip>", None, ""}


# Language


def test_language_held_out_accuracy(table):
    docs = table("documents", "/root/testdata/sf0.01")
    found = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and found.score.between(0, 1).all() and found.accepted.mean() > 0.98


def test_language_of_odd_rows(spark, odd):
    found = language.identify(odd).collect()
    assert len(found) == odd.count()
    assert {r.lang_pred for r in found if r.doc_id in (4, 5, 6, 7)} == {"und"} and not any(r.accepted for r in found if r.doc_id == 7)
    assert language.identify(odd.limit(0)).count() == 0
    unlabelled = language.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language.keep_identified(odd).columns == odd.columns


def test_cut_texts_give_the_same_sums(monkeypatch):
    table_ = np.random.default_rng(0).normal(size=(1 << language.BITS, 3)).astype(np.float32)
    texts = ["Ein Satz über nichts. " * 40, "", "a", "x" * 300 + " tail"]
    whole = language.scan(texts, table_)
    monkeypatch.setattr(language, "STEP_CHARS", 100)
    cut = language.scan(texts, table_)
    # A cut hides at most the boundary before its first letter.
    assert np.allclose(whole[1], cut[1], atol=0.05 * whole[1].max())


# Quality


def naive_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("name", ["odd", "planted"])
def test_measures_equal_counting(spark, odd, name):
    texts = ["a b c d e f a b c d e", "x " * 30, "a b c d e a b c d e a b c d e q", "l\n\nl\n l\nl", "a|b <c> #", "à b\x0bc\x1fd", "one two three four five"]
    docs = odd if name == "odd" else spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    rows = Counter((r.doc_id, *naive_quality(r.text)) for r in docs.collect())
    found = quality.measures(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == rows


def test_fences_adapt_to_groups(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(i, words + " #" * (i % 3), "en", "a") for i in range(150)] + [(200 + i, words + " #" * (30 + i % 3), "en", "b") for i in range(150)]
    rows += [(500, words + " #" * 60, "en", "a"), (501, words + " #" * 34, "en", "b"), (502, words + " #" * 34, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("text", docs["text"])
    kept = {r.doc_id: r.kept for r in quality.judge(docs, least_rows=100).collect()}
    assert not kept[500] and not kept[502] and all(kept[i] == kept[0] for i in range(150))


def test_judging_odd_rows(odd):
    found = quality.judge(odd).collect()
    assert len(found) == odd.count() and all(r.base_failed and not r.kept for r in found if r.doc_id in (4, 5, 6))
    assert quality.judge(odd.limit(0)).count() == 0


# Mixing


def test_mixing_meets_targets(spark, table):
    docs, labels = table("documents", "/root/testdata/sf0.01"), table("labels", "/root/testdata/sf0.01")
    targets = {"good": 0.7, "low": 0.25, "toxic": 0.04, "low_toxic": 0.01}
    found = mixing.mixing_rates(docs, mixing.labelled_domains(labels), targets).toPandas()
    total = found.n_tokens.sum()
    got = {d: (found.rate * found.n_tokens * found.posteriors.map(lambda p: p[d])).sum() / total for d in targets}
    assert (found.rate >= 0).all() and len(found) == docs.count()
    assert all(abs(got[d] - share) < 1e-4 for d, share in targets.items())
    copies = mixing.mixed(docs, spark.createDataFrame(found[["doc_id", "rate"]]))
    assert copies.columns == docs.columns and abs(copies.count() / found.rate.sum() - 1) < 0.1


def test_projected_gradient_equals_dense_solution(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    n = rng.integers(1, 500, 60)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(60)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    found = mixing.fitted(members, ["x", "y", "z"], {"x": 0.5, "y": 0.3, "z": 0.2}).toPandas().sort_values("doc_id")
    a, w = n[:, None] * p, np.ones(60)
    goal = np.array([0.5, 0.3, 0.2]) * n.sum()
    inverse = np.linalg.inv(a.T @ a)
    for _ in range(5000):
        w = np.maximum(0, w - a @ (inverse @ (a.T @ w - goal)))
    assert np.abs(a.T @ found.rate.to_numpy() - goal).max() <= 1e-5 * n.sum() and np.allclose(found.rate, w, atol=1e-3)


def test_mixing_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0, 5), (3, 0, 1, 5), (12, 0, 0, 5), (None, 1, 1, 5), (9, None, 0, 5), (1, 0, 0, 5)], "doc_id long, quality int, toxic int, text long")
    domains = mixing.labelled_domains(labels)
    rates = mixing.mixing_rates(odd, domains, {"good": 0.5, "low": 0.5})
    found = rates.collect()
    assert len(found) == len({r[0] for r in odd_rows()}) and all(r.rate >= 0 for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (4, 5, 6)} == {0}
    assert mixing.mixed(odd, rates).columns == odd.columns
    clash = odd.withColumnsRenamed({"n": "rate", "h": "_rate", "k": "times", "words": "row"}).withColumn("key", F.lit("c"))
    kept = mixing.mixed(clash, rates)
    assert kept.columns == clash.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in mixing.mixed(odd, rates).collect())
    twice = mixing.mixed(odd, rates.withColumn("rate", F.lit(2.0)))
    assert twice.count() == 2 * odd.count()
    assert mixing.mixing_rates(odd.limit(0), domains, {"good": 1.0}).count() == 0
    assert {r.rate for r in mixing.mixing_rates(odd, domains.limit(0), {"good": 1.0}).collect()} == {1.0}


PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=300, deadline=None)
@given(st.text("0129.. a", max_size=40))
def test_addresses_from_the_start_of_a_run_are_those_of_the_plain_pattern(text):
    assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in PLAIN_IP.finditer(text)]


def test_a_million_digits_take_no_time():
    start = time.perf_counter()
    assert not list(pii.IP.finditer("7" * 1_000_000)) and len(list(pii.IP.finditer("1.2.3.4 " + "9." * 300_000))) > 1
    assert time.perf_counter() - start < 5


# Licences


@pytest.mark.parametrize(
    "text, names",
    [
        ("Foo bar.\nReleased under the MIT License.", ["MIT"]),
        ("RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!", ["MIT"]),
        ("// Licensed under the Apache License, Version 2.0 (the \"License\"). You may obtain a copy of the License at x.org", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", ["CC-BY-NC", "GPL-3.0"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("Redistribution and use in source and binary forms are permitted. 1. Redistributions of source code must retain it. 2. Redistributions in binary form must reproduce it.", ["BSD-2-Clause"]),
        ("Copyright (c) 2020 Me. All rights reserved.", ["Proprietary"]),
        ("We lost the driving license.", []), ("", []), (None, []), ("plain", []),
    ],
)
def test_licences(spark, text, names):
    (row,) = licences.licences(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, rest long")).collect()
    assert row.licences == names and row.n_unknown == ("driving" in (text or ""))


# Standard notices as files have them, wrapped and behind comment marks.
GPL = """This {thing} is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This {thing} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {thing}.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
MIT = """MIT License

Copyright (c) 2021 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (GPL.format(thing="program", kind="", version=3), "GPL-3.0"), (GPL.format(thing="program", kind="", version=2), "GPL-2.0"),
    (GPL.format(thing="program", kind="Affero ", version=3), "AGPL"), (GPL.format(thing="library", kind="Lesser ", version=3), "LGPL"),
    (BSD, "BSD-2-Clause"), (BSD + BSD3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (MIT, "MIT"), (MPL, "MPL-2.0"),
]


def test_wrapped_notices_behind_comment_marks(spark):
    marks = ("", "// ", "# ", " * ", "-- ", ";; ")
    cases = [(text, name, mark, end) for text, name in NOTICES for mark in marks for end in ("\n", "\r\n")]
    texts = ["code = 1\n\n" + end.join(mark + line for line in text.split("\n")) + end + "\nmore code" for text, _, mark, end in cases]
    found = licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    wrong = [(cases[r.doc_id][1:], r.licences) for r in found if r.licences != [cases[r.doc_id][1]]]
    assert wrong == []


def test_licence_sql_reads_notices_alike(spark, odd):
    texts = [t for t, _ in NOTICES] + ["\n".join("# " + x for x in t.split("\n")) for t, _ in NOTICES] + [r[1] for r in odd_rows()] + ["a\nReleased under the MIT License\nb\nc", "driving license\n\nlicensed under\nthe mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = {r[0]: r[1:] for r in con.sql(f"select doc_id, licences, sentences, n_unknown from ({licences.licences_sql()})").fetchall()}
    got = licences.licences(docs).collect()
    assert {r.doc_id: (",".join(r.licences), ",".join(r.sentences), r.n_unknown) for r in got} == expected


def test_licences_of_odd_rows(odd):
    assert licences.licences(odd).count() == odd.count() and licences.licences(odd.limit(0)).count() == 0


# Secrets


def planted_secrets(n):
    out = []
    for i in range(n):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        kind = i % 4
        line = (f'token = "{key}"', f"commit {key}", f"see 4111111111111{i:04d} there", "an extraordinarilylongwordwithoutmeaning here")[kind]
        out.append((i, f"Some words before it and\n{line} and some after", f"src/{i}.py"))
    return out


PLAIN_VALUE = re.compile(
    r"""(?i)(token|secret|passw(or)?d|pwd|api_?key|access_?key|auth|credential|private_?key)\w*["']?\s*(=|:|=>|:=)\s*"""
    r"""(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s"'`]+))"""
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "my_token", "x", " ", "=", ": ", '"', "'", "abc123", "\n", "auth", "tokenauth", ",", "foo="]), max_size=14).map("".join))
def test_assigned_values_are_those_of_the_plain_pattern(text):
    expected = []
    for m in PLAIN_VALUE.finditer(text):
        start, end = m.span(m.lastgroup)
        expected.append((start, start + len(text[start:end].rstrip(",;)]}")) if m.lastgroup == "bare" else end))
    assert secrets.assigned(text) == expected
    assert [("pwd => abc123")[a:b] for a, b in secrets.assigned("pwd => abc123")] == ["abc123"]


def test_long_runs_of_key_words_take_no_time():
    start = time.perf_counter()
    assert secrets.proposed("token" * 200_000 + " = x") and len(secrets.proposed('token = "abc123xyz" ' * 20_000)) == 20_000
    assert time.perf_counter() - start < 20


def test_forest_tells_secrets_from_digests(spark):
    docs = spark.createDataFrame(planted_secrets(240), "doc_id long, text string, source string")
    found = secrets.candidates(docs, secrets.dictionary(docs))
    seen, held = found.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    verdict = secrets.scan(held, labelled=seen).toPandas()
    right = [bool(r.is_secret) == (r.doc_id % 4 == 0) for r in verdict.itertuples()]
    assert len(right) >= 40 and np.mean(right) > 0.95


def test_features_and_spans():
    assert len(secrets.features("a1" * 10, "key = ", "", "x/y.env", {"key"}, 5)) == len(secrets.FEATURES)
    assert secrets.coverage("houseboat", {"house", "boat"}, 5) == 1
    assert secrets.self_evident("AKIA" + "A1" * 8, "") == ("aws_key", 1)


def test_secrets_of_odd_rows(spark, odd):
    assert secrets.scan(odd).count() == 0 and secrets.scan(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "api_key=" + "ab12" * 8, None), (1, "api_key=" + "ab12" * 8, None)], "doc_id long, text string, source string")
    found = secrets.scan(docs).collect()
    assert [(r.doc_id, r.start, r.end, r.is_secret) for r in found] == [(1, 8, 40, True)] * 2


@pytest.mark.parametrize(
    "text, value",
    [
        ('password = "Tr0ub4dor&3"', "Tr0ub4dor&3"), ("DB_PASSWORD: 'a!b@c#d.1'", "a!b@c#d.1"), ("pwd=hunter2!x, next", "hunter2!x"),
        ("postgres://me:p@ss:w0rd!@db.host/x", "p@ss:w0rd!"), ("AKIA" + "A1" * 8 + "=prod", "AKIA" + "A1" * 8), ("key=AKIA" + "A1" * 8, "AKIA" + "A1" * 8),
        ("token = " + "ab12" * 5 + "==", "ab12" * 5 + "=="), ('{"secret": "x y-z 9"}', "x y-z 9"),
    ],
)
def test_whole_values_are_candidates(spark, text, value):
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    rows = secrets.candidates(docs, set()).collect()
    assert value in {r.value for r in rows} and all(text[r.start : r.end] == r.value for r in rows) and len({(r.start, r.end) for r in rows}) == len(rows)
    assert value in {r.value for r in secrets.scan(docs).collect() if r.is_secret}


def test_forest_judges_known_formats(spark):
    docs = spark.createDataFrame([(1, "see AKIA" + "A1" * 8 + " there", "src/a.py")] + planted_secrets(80)[1:], "doc_id long, text string, source string")
    found = secrets.candidates(docs, set())
    false = found.withColumn("label", F.when(F.col("format").isNotNull(), 0).otherwise(F.col("label")))
    false = false.unionByName(false.filter("format is not null").crossJoin(spark.range(60)).drop("id"))
    verdict = secrets.scan(docs, labelled=false).filter("format is not null").collect()
    assert verdict and all(r.is_secret == (r.probability >= 0.5) for r in verdict) and not any(r.is_secret for r in verdict)
