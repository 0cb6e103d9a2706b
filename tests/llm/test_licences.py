"""Licence scans: wrapped headers, whole licence files, and scores against a plain TF-IDF."""

from __future__ import annotations

import math
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import licenses

SCHEMA = "doc_id int, place string, text string"
GNU = (
    "This program is free software{0} you can redistribute it and/or modify it under the terms of "
    "the GNU {1} as published by the Free Software Foundation{0} either version {2} of the License, "
    "or (at your option) any later version.\n\nThis program is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
    "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
APACHE = next(t for name, t in licenses.TEMPLATES if name == "Apache-2.0" and "See the License" in t)
MIT = next(t for name, t in licenses.TEMPLATES if name == "MIT" and "THE SOFTWARE IS" in t)
BSD = {
    name: next(t for n, t in licenses.TEMPLATES if n == name and "DISCLAIMED" in t)
    for name in ("BSD-2-Clause", "BSD-3-Clause")
}
CODE = "\n".join(f"int value_{n} = compute({n}, offset);" for n in range(60))


def wrapped(text: str, mark: str = "", width: int = 70) -> str:
    lines = []
    for part in text.split("\n\n"):
        lines += [mark + x for x in textwrap.wrap(part, width)] + [mark.rstrip()]
    return "\n".join(lines)


HEADERS = {
    "MPL-2.0": MPL,
    "GPL-2.0": GNU.format(";", "General Public License", "2"),
    "GPL-3.0": GNU.format(":", "General Public License", "3"),
    "LGPL-2.1": GNU.format(";", "Lesser General Public License", "2.1"),
    "LGPL-3.0": GNU.format(":", "Lesser General Public License", "3"),
    "AGPL-3.0": GNU.format(":", "Affero General Public License", "3"),
    "Apache-2.0": APACHE,
    "MIT": MIT,
    **BSD,
}


@pytest.fixture(scope="module")
def headers(spark):
    """Each header whole, wrapped under comment marks, and wrapped right below other text."""
    rows, wanted = [], {}
    for name, text in HEADERS.items():
        for form in (
            text + "\n\n" + CODE,
            "/*\n" + wrapped(text, " * ") + "\n */\n\n" + CODE,
            wrapped("Some module\n\n" + text, "# ", 60) + "\n\n" + CODE,
            "\r\n".join(wrapped(text, "// ", 78).split("\n")) + "\r\n\r\n" + CODE,
        ):
            wanted[len(rows)] = name
            rows.append((len(rows), f"src/{len(rows)}/x.c", form))
    found = licenses.scanned(spark.createDataFrame(rows, SCHEMA), F.col("place")).collect()
    return {r.doc_id: r for r in found}, wanted


def test_headers_wrapped_or_not(headers):
    found, wanted = headers
    assert {i: r.own_licence for i, r in found.items()} == wanted


def test_whole_licence_files(spark):
    texts = {name: wrapped(HEADERS[name]) for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause")}
    rows = []
    for n, (name, text) in enumerate(texts.items()):
        # No file name tells these; their own words do.
        rows += [(10 * n, f"d{n}/TEXT", text), (10 * n + 1, f"d{n}/sub/q.c", CODE)]
    found = {
        r.doc_id: r
        for r in licenses.scanned(spark.createDataFrame(rows, SCHEMA), F.col("place")).collect()
    }
    for n, name in enumerate(texts):
        assert found[10 * n].own_licence == name
        assert (found[10 * n + 1].licence, found[10 * n + 1].inherited_from) == (name, f"d{n}")


def test_notices_that_fit_two_licences_name_none(spark):
    templates = [("one", "this licence grants much"), ("two", "this licence grants much")]
    docs = spark.createDataFrame([(1, "a", "this licence grants much")], SCHEMA)
    assert licenses.scanned(docs, F.col("place"), templates=templates).first().own_licence is None


def test_prose_about_licences_is_left_alone(spark):
    prose = (
        "The council renewed the fishing licence of the harbour last week.\nBoats may leave with "
        "permission of the master, who keeps a copy of every paper.\nNobody else may grant it."
    )
    docs = spark.createDataFrame([(1, "a/b", prose), (2, "a/c", "")], SCHEMA)
    assert all(r.licence is None for r in licenses.scanned(docs, F.col("place")).collect())


# -- the same by plain Python --------------------------------------------------------------


def units_of(text: str, path: str) -> list[str]:
    notice = re.compile(licenses.NOTICE)
    if not notice.search(text):
        return []
    text_lines = [x if re.search(r"[^\W_]", x) else "" for x in text.split("\n")]
    text_lines = [f"\n{x}\n" if len(x) > 200 else x for x in text_lines]
    paragraphs = re.split(r"\n{2,}", "\n".join(text_lines))

    def around(parts, reach, mark):
        marked = [i for i, x in enumerate(parts) if notice.search(x)]
        near = sorted({j for i in marked for j in range(i - reach, i + reach + 1) if 0 <= j < len(parts)})
        groups: list[list[int]] = []
        for j in near:
            if groups and groups[-1][-1] == j - 1:
                groups[-1].append(j)
            else:
                groups.append([j])
        return [mark.join(parts[j] for j in g) for g in groups if len(g) > 1]

    noted = [p for p in paragraphs if notice.search(p)]
    found = [x for p in noted for x in p.split("\n") if notice.search(x)]
    found += [x for p in noted for x in around(p.split("\n"), licenses.REACH, "\n")]
    found += around(paragraphs, 0, "\n\n")
    if re.search(licenses.FILE_NAME, path) or sum(map(len, noted)) >= licenses.WHOLE_SHARE * len(text):
        found.append(text)
    return found


def best_by_hand(rows) -> dict[int, tuple]:
    def terms(text):
        return Counter(re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower()))

    units = [(i, terms(u)) for i, path, text in rows for u in units_of(text, path)]
    df = Counter(t for _, counts in units for t in counts)

    def vector(counts):
        own = {
            t: (1 + math.log(n)) * (math.log((1 + len(units)) / (1 + df[t])) + 1)
            for t, n in counts.items()
        }
        length = math.sqrt(sum(w * w for w in own.values()))
        return {t: w / length for t, w in own.items()}

    wanted = [(name, vector(terms(text))) for name, text in licenses.TEMPLATES]
    best: dict[int, tuple] = {}
    for i, counts in units:
        own = vector(counts)
        scores: dict[str, float] = {}
        for name, other in wanted:
            dot = sum(w * other.get(t, 0.0) for t, w in own.items())
            scores[name] = max(scores.get(name, 0.0), dot)
        (top, name), (second, _) = sorted(((s, n) for n, s in scores.items()), reverse=True)[:2]
        if top >= licenses.LEAST_COSINE and top - second >= licenses.LEAST_LEAD:
            best[i] = max(best.get(i, (0.0, "")), (round(top, 6), name))
    return best


def test_scores_against_plain_tfidf(spark):
    texts = list(HEADERS.values()) + [
        "intro line\nmore of it\n" + wrapped(MPL, "; ") + "tail\n" + CODE,
        "All rights reserved.\nx\ny\nz\nw\nv\nu\nt\nReleased under the MIT License.\nq",
        "no word of it", "", "Licensed under CC BY-SA 4.0.\n\n--\n\nLicensed under CC BY 4.0.",
    ]
    rows = [(n, f"p/{n}/f" if n % 2 else f"p/{n}/LICENSE", wrapped(t) if n % 3 else t) for n, t in enumerate(texts)]
    found = licenses.scanned(spark.createDataFrame(rows, SCHEMA), F.col("place")).collect()
    by_hand = best_by_hand(rows)
    assert {r.doc_id: (round(r.score, 6), r.own_licence) for r in found if r.own_licence} == by_hand
    assert len(by_hand) > len(HEADERS)
