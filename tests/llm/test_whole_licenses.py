"""Licenses whose label a gate lost."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import licenses


@pytest.mark.parametrize(("text", "label"), [("released under MIT", "mit"), ("distributed under the terms of zlib", "zlib"), ("placed in the public\ndomain", "public-domain"), ("the Open\nSoftware License 3.0", "osl-3"), ("Creative Commons Attribution-Non-Commercial 4.0", "cc-by-nc"), ("Creative Commons Attribution Share-Alike 4.0", "cc-by-sa"), ("SPDX-License-Identifier: AFL-3.0", "afl-3"), ("released under the Expat license", "mit")])
def test_labels_that_the_gate_lost(spark, text, label):
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.labels == label


def test_gates_lose_nothing():
    names = "mit|isc|zlib|openssl|postgresql|expat|psf license|cddl|afl 3 0|bsl 1 0|gnu gpl v2|cc by nc|creative commons attribution no derivs|do what the fuck you want to public license".split("|")
    forms = ["released under {}", "under the terms of {}", "spdx license identifier {}", "license {}", "see the {} license", "{}", "under the terms of the gnu general public license as published by the free software foundation either version 2 {}", "proprietary and confidential {}", "plain words"]
    for text in (f.format(n) for f in forms for n in names):
        ungated = licenses.detections(text, gated=False)
        assert licenses.detections(text) == ungated


@pytest.mark.parametrize(("text", "label"), [
    ("Released under the MIT.", "mit"), ("Distributed under MIT", "mit"), ("available under the ISC", "isc"), ("published under zlib", "zlib"), ("released under PostgreSQL", "postgresql"),
    ("released under the expat", "mit"), ("Creative Commons Attribution Non-Commercial 4.0", "cc-by-nc"), ("Creative Commons Attribution No-Derivatives 4.0", "cc-by-nd"), ("a new BSD unix book", ""),
    ("under the new BSD license", "bsd-3-clause"), ("This is not released under the ISC license.", ""), ("Not released under the MIT license", "mit"), ("GPL v2 with the Classpath Exception", "gpl-classpath-exception"), ("the mit", ""),
    ("See http://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa"), ("https://www.apache.org/licenses/LICENSE-2.0.txt", "apache-2"), ("Confidential and proprietary", "proprietary"),
])
def test_labels(text, label):
    row = scan([text])[0]
    assert row["labels"] == label


@pytest.mark.parametrize(("text", "label"), [
    ("GPLv2", "gpl-2"), ("This is LGPLv3 code", "lgpl-3"), ("AGPLv3", "agpl-3"), ("MPLv2", "mpl-2"), ("GPL3", "gpl-3"), ("Apache2 license", "apache-2"), ("the Apache License", "apache"), ("under ASL, the Apache Software License 2.0", "apache-2"),
    ("BSD-3", "bsd-3-clause"), ("BSD license", "bsd"), ("a BSD system", ""), ("GPL", "gpl"), ("GNU General Public License", "gpl"), ("Mozilla Public License", "mpl"), ("licensed under the terms of the GPL", "gpl"),
    ("gnu lesser gpl v3", "lgpl-3"), ("GNU Lesser General Public License", "lgpl"), ("GPL-2.0-or-later", "gpl-2"), ("GPL, version 2", "gpl-2"), ("GPLv2. See the GNU General Public License for more", "gpl-2"),
    ("Instead of waiting, read the MIT license", "mit"), ("Instead of the MIT license we have none", ""), ("It is not released. Under the terms of the ISC license", "isc"), ("not released under the terms of the ISC license", ""),
    ("Other than that: see the zlib license", "zlib"), ("Rather than fight; license MIT", "mit"), ("EPL-2.0", "epl-2"), ("Eclipse Public License", "epl"), ("dual licensed under MIT and the GPLv3", "gpl-3,mit"),
])
def test_what_people_write(text, label):
    assert scan([text])[0]["labels"] == label


def scan(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return [r for b in licenses.scanned(iter([batch])) for r in b.to_pylist()]


@given(st.sampled_from(licenses.RULES).flatmap(lambda r: st.from_regex(r.pattern)))
@settings(max_examples=300, deadline=None)
def test_gates_lose_nothing_of_any_rule(text):
    joined = " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split())
    ungated = licenses.detections(joined, gated=False)
    assert licenses.detections(joined) == ungated


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from("abc"), st.integers(0, 3)), max_size=25))
def test_settling_is_brute_force(spans):
    found = [licenses.Detection(a, a + n, label, p, 0.5) for a, n, label, p in spans]
    kept = []
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    assert licenses.settled(found) == kept


BASE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
p AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM w),
hits AS (SELECT doc_id, i, label FROM p JOIN (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) b(phrase, label) ON w[i + 1:i + len(phrase)] = phrase)
SELECT w.doc_id, len(any_value(w)) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id ORDER BY w.doc_id
"""


def test_base_columns_are_the_sql():
    parts = ["under the MIT license", "Apache License, Version 2.0", "cc-by-nc", "CC BY NC nc", "under the mit", "licence x", "\u00fcber", "the\n\n", "", "version 2", "apache license"]
    rows = [(i, " ".join(parts[(i * 7 + k * (1 + i % 5)) % len(parts)] for k in range(i % 9))) for i in range(120)] + [(200, None), (201, ""), (202, "cc by nc " * 300), (203, "cc by cc by nc by nc")]
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", rows)
    got = [(rows[r["doc_id"]][0], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scan([t for _, t in rows])]
    assert got == con.sql(BASE_SQL).fetchall()
