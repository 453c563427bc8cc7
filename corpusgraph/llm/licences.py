"""Licence scan by the Dice coefficient over word bigrams, in SQL functions only.

A text is normalised (lower case, every run of other than letters and digits one
blank).  Its lines, and the whole text as one unit, are compared with licence
templates: Dice = 2 |A & B| / (|A| + |B|) over bags of word bigrams (no template of
one line repeats a bigram, so |A & B| counts different ones).  Dice >= t
forces |A| between |B| t / (2 - t) and |B| (2 - t) / t, so a unit whose number of
words is out of all templates' bounds is dropped before bigrams are built, and
only templates within bounds are compared.  Templates are a short fixed list, so
rows never move between tasks.

Notices inside longer lines, wrapped over lines or in a text without line feeds are
windows of words.  A window that reaches Dice t with a template of n word pairs
(counted as bags) shares n t / (2 - t) of them, so a text without any of certain
words of the template has none, and a best window begins and ends at shared pairs:
only those are tried, all of them.  Of windows that overlap the best counts (the
longer one, then the first name, among equals).  Next to lines and the whole text,
a window counts where no matching unit that it overlaps is as good or has its name.
Licence texts and standard headers (``TEXTS``) are compared with windows only.

Edge cases: null or empty text has no licence; a unit of one word has no bigram
and matches nothing; of templates that tie the first by name is named; repeated
lines count each; very long lines are dropped by the bounds, never cut, and searched
by windows like all others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# The customary one-line notices of common licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APPEAR = ", provided that the above copyright notice and this permission notice appear in all copies. "
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu_header(work: str, licence: str, version: str) -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {licence} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {licence} for more details."
    )


def _gnu_title(licence: str, version: str, foundation: str) -> str:
    return f"{licence} Version {version} Copyright (C) {foundation} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _cc_title(kind: str) -> str:
    title = f"Creative Commons {kind} 4.0 International Public License"
    return f'{title} By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {title} ("Public License").'


_FSF = "Free Software Foundation, Inc. <https://fsf.org/>"
_FSF_OLD = "Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
# Whole texts of short licences, standard headers, and the openings of long licence texts; compared as windows.
TEXTS = [
    ("0BSD", f"{_PERMIT}. {_AUTHOR}"),
    ("AGPL-3.0", _gnu_header("program", "GNU Affero General Public License", "3")),
    ("AGPL-3.0", _gnu_title("GNU AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", f"2007 {_FSF}")),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_AS_IS),
    ("CC-BY-4.0", _cc_title("Attribution")),
    ("CC-BY-NC-4.0", _cc_title("Attribution-NonCommercial")),
    ("CC-BY-SA-4.0", _cc_title("Attribution-ShareAlike")),
    ("CC0-1.0", "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
    ("GPL-2.0", _gnu_header("program", "GNU General Public License", "2")),
    ("GPL-2.0", _gnu_title("GNU GENERAL PUBLIC LICENSE", "2, June 1991", f"1989, 1991 {_FSF_OLD}")),
    ("GPL-3.0", _gnu_header("program", "GNU General Public License", "3")),
    ("GPL-3.0", _gnu_title("GNU GENERAL PUBLIC LICENSE", "3, 29 June 2007", f"2007 {_FSF}")),
    ("ISC", _PERMIT + _APPEAR),
    ("ISC", _PERMIT + _APPEAR + _AUTHOR),
    ("LGPL-2.1", _gnu_header("library", "GNU Lesser General Public License", "2.1")),
    ("LGPL-2.1", _gnu_title("GNU LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", f"1991, 1999 {_FSF_OLD}")),
    ("LGPL-3.0", _gnu_header("library", "GNU Lesser General Public License", "3")),
    ("LGPL-3.0", _gnu_title("GNU LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", f"2007 {_FSF}")),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_AS_IS),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
]


def normalised(text: Column) -> Column:
    """Lower case; line feeds stay, every other run of non-letters and non-digits is one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def bigrams(unit: Column) -> Column:
    """Word pairs of a trimmed, normalised unit, in order."""
    words = F.split(unit, " ")
    return F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def _template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, t: float) -> tuple[int, int]:
    """Sizes of a set that can reach Dice t with a set of n."""
    fits = [k for k in range(1, int(n * (2 - t) / t) + 2) if 2 * min(n, k) / (n + k) >= t]
    return fits[0], fits[-1]


WINDOW = "array<struct<from:int,to:int,dice:double,name:string>>"
# words rare in prose, tried first to tell texts that can hold a template; then longer ones are rarer
RARE = ("licensed", "license", "gnu", "apache", "mozilla", "bsd", "isc", "cc0", "cc")


def _bag(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _guard(pairs: list[str], need: int) -> set[str]:
    """Words of which a text holds at least one if it holds ``need`` of the pairs."""
    left, out = Counter(pairs), set()
    for w in sorted({w for p in pairs for w in p.split()}, key=lambda w: (RARE.index(w) if w in RARE else len(RARE), -len(w), w)):
        if left.total() < need:
            break
        if any(w in p.split() for p in left):
            out.add(w)
            left = Counter({p: c for p, c in left.items() if w not in p.split()})
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(flat: Column, threshold: float, templates: list[tuple[str, str]]) -> Column:
    """Struct of windows (positions of their first and last word pair, best of overlapping ones) and the line of each word."""
    known = [(name, _bag(text)) for name, text in templates]
    spans = [bounds(len(b), threshold) for _, b in known]
    words = sorted(set().union(*(_guard(b, need) for (_, b), (need, _) in zip(known, spans))))
    every = sorted({p for _, b in known for p in b})
    patterns = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(len(b)).alias("n"), F.lit(need).alias("need"), F.lit(most).alias("most"), F.array(*map(F.lit, b)).alias("pairs")) for (k, b), (need, most) in zip(known, spans)))

    def grown(p: Column, hits: Column, x: Column, i: Column) -> Column:
        """The best window from hit x (the i-th) on."""
        after = F.filter(F.slice(hits, i + 1, p["most"]), lambda y: y["at"] - x["at"] < p["most"])

        def best(w: Column) -> Column:
            rows = _let(F.transform(w, lambda y: y["pair"]), lambda b: F.transform(w, lambda y, k: F.struct(y["at"].alias("at"), F.when(k + 1 - F.size(F.array_remove(F.slice(b, F.lit(1), k + 1), y["pair"])) <= y["times"], 1).otherwise(0).alias("new"))))

            def step(s: Column, y: Column) -> Column:
                n = s["n"] + y["new"]
                dice = n * F.lit(2.0) / (y["at"] - x["at"] + 1 + p["n"])
                more = dice > s["dice"]
                return F.struct(n.alias("n"), F.when(more, dice).otherwise(s["dice"]).alias("dice"), F.when(more, y["at"]).otherwise(s["to"]).alias("to"))

            return F.aggregate(rows, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("dice"), F.lit(0).alias("to")), step)

        return _let(_let(after, best), lambda s: F.struct(x["at"].alias("from"), s["to"].alias("to"), s["dice"].alias("dice"), p["name"].alias("name")))

    def candidates(p: Column, hits: Column) -> Column:
        own = F.filter(F.transform(hits, lambda x: F.struct(x["at"].alias("at"), x["pair"].alias("pair"), (p["n"] - F.size(F.array_remove(p["pairs"], x["pair"]))).alias("times"))), lambda x: x["times"] > 0)
        dense = lambda h: F.transform(h, lambda x, i: F.when(F.get(h, i + p["need"] - 1)["at"] - x["at"] < p["most"], grown(p, h, x, i)))
        return F.filter(_let(own, dense), lambda w: w["dice"] >= threshold)

    def found(hits: Column) -> Column:
        some = lambda p, d: F.size(F.array_intersect(p["pairs"], d)) >= p["need"] - p["n"] + F.size(F.array_distinct(p["pairs"]))
        able = _let(F.array_distinct(F.transform(hits, lambda x: x["pair"])), lambda d: F.filter(patterns, lambda p: some(p, d)))
        return F.flatten(F.transform(able, lambda p: candidates(p, hits)))

    none = F.array().cast(WINDOW)

    def chosen(island: Column) -> Column:
        ranked = F.array_sort(F.transform(island, lambda w: F.struct((-w["dice"]).alias("loss"), (w["from"] - w["to"]).alias("size"), w["name"].alias("name"), w["from"].alias("from"), w["to"].alias("to"))))
        as_window = lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), (-r["loss"]).alias("dice"), r["name"].alias("name"))
        free = lambda s, r: ~F.exists(s, lambda y: (y["from"] <= r["to"] + 1) & (r["from"] <= y["to"] + 1))
        return F.aggregate(ranked, none, lambda s, r: F.when(free(s, r), F.concat(s, F.array(as_window(r)))).otherwise(s))

    def apart(windows: Column) -> Column:
        """The best of overlapping windows, island by island of the text."""
        start = F.struct(none.alias("done"), none.alias("open"), F.lit(-2).alias("reach"))

        def step(s: Column, w: Column) -> Column:
            new = w["from"] > s["reach"] + 1
            return F.struct(
                F.when(new, F.concat(s["done"], chosen(s["open"]))).otherwise(s["done"]).alias("done"),
                F.when(new, F.array(w)).otherwise(F.concat(s["open"], F.array(w))).alias("open"),
                F.greatest(s["reach"], w["to"]).alias("reach"),
            )

        return F.aggregate(F.array_sort(windows), start, step, lambda s: F.concat(s["done"], chosen(s["open"])))

    def search(lines: Column) -> Column:
        pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, i: F.concat(a, F.lit(" "), F.get(w, i + 1)))
        hits = F.filter(F.transform(_let(F.flatten(lines), pairs), lambda b, i: F.when(b.isin(every), F.struct(i.alias("at"), b.alias("pair")))), lambda x: x.isNotNull())
        return F.struct(apart(_let(hits, found)).alias("windows"), F.flatten(F.transform(lines, lambda w, i: F.transform(w, lambda _: i))).alias("line"))

    split = F.transform(F.split(flat, "\n"), lambda u: F.filter(F.split(u, " "), lambda w: w != ""))
    return F.when(flat.rlike(rf"(?:^|[ \n])(?:{'|'.join(words)})(?:[ \n]|$)"), _let(split, search))


def scan_licences(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """``docs`` with licences (array of struct dice, name: one per matching unit or window, the best template of each)."""
    known = {k: _template_bigrams(v) for k, v in sorted(templates.items())}
    spans = {k: bounds(len(b), threshold) for k, b in known.items()}
    least, most = min(lo for lo, _ in spans.values()), max(hi for _, hi in spans.values())
    pairs = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))

    def best(a: Column) -> Column:
        found = []
        for name, b in known.items():
            dice = F.size(F.array_intersect(a, F.array(*map(F.lit, b)))) * F.lit(2.0) / (F.size(a) + F.lit(len(b)))
            found.append(F.when(F.size(a).between(*spans[name]), F.struct(dice.alias("dice"), F.lit(name).alias("name"))))
        start = F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name"))
        return F.aggregate(F.array(*found), start, lambda s, x: F.when((x["dice"] >= threshold) & (x["dice"] > s["dice"]), x).otherwise(s))

    flat = F.col("licence_flat")
    whole = F.when(flat.contains("\n"), F.array(F.regexp_replace(flat, r"[ \n]+", " "))).otherwise(F.array().cast("array<string>"))
    # one unit per line, then the whole text; null where the size is out of bounds
    units = F.transform(F.transform(F.concat(F.split(flat, "\n"), whole), lambda u: F.trim(u)), lambda u: F.when(pairs(u).between(least, most), bigrams(u)))
    out = docs.withColumn("licence_flat", normalised(F.col("text"))).withColumn("licence_units", F.transform(units, lambda a: F.when(a.isNotNull(), best(a))))
    out = out.withColumn("licence_windows", _windows(flat, threshold, [*templates.items(), *texts]))

    def alone(s: Column) -> Column:
        def met(w: Column, u: Column) -> Column:
            return u["name"].isNotNull() & ((u["dice"] >= w["dice"]) | (u["name"] == w["name"]))

        lines = lambda w: F.slice("licence_units", F.get(s["line"], w["from"]) + 1, F.get(s["line"], w["to"] + 1) - F.get(s["line"], w["from"]) + 1)
        text = lambda w: F.when(flat.contains("\n"), F.slice("licence_units", -1, 1)).otherwise(F.slice("licence_units", 1, 1))
        return F.filter(s["windows"], lambda w: ~F.exists(F.concat(lines(w), text(w)), lambda u: F.coalesce(met(w, u), F.lit(False))))

    plain = lambda a: F.transform(a, lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name")))
    matching = plain(F.filter("licence_units", lambda x: x["name"].isNotNull()))
    inside = F.when(F.size("licence_windows.windows") > 0, plain(_let(F.col("licence_windows"), alone)))
    none = F.array().cast("array<struct<dice:double,name:string>>")
    return out.withColumn("licences", F.concat(F.coalesce(matching, none), F.coalesce(inside, none))).drop("licence_flat", "licence_units", "licence_windows")


def licences_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_licences, best_licence, best_dice, licences (distinct names, sorted, joined by commas)."""
    out = scan_licences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    top = F.aggregate("licences", F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name")), lambda s, x: F.when((x["dice"] > s["dice"]) | ((x["dice"] == s["dice"]) & (x["name"] < s["name"])), x).otherwise(s))
    return out.withColumn("top", top).select(
        "doc_id",
        F.size("licences").cast("long").alias("n_licences"),
        F.col("top.name").alias("best_licence"),
        F.when(F.col("top.name").isNotNull(), F.col("top.dice")).alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["name"]))), ",").alias("licences"),
    )


def oracle(threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> str:
    """The same scan as DuckDB SQL over the view ``documents``."""
    rows = ", ".join(f"('{k}', {_template_bigrams(v)!r})" for k, v in sorted(templates.items()))
    return rf"""
WITH templates(name, pairs) AS (VALUES {rows}),
flat AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents),
units AS (
  SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS u FROM flat
  UNION ALL SELECT doc_id, trim(regexp_replace(t, '[ \n]+', ' ', 'g')) FROM flat WHERE contains(t, chr(10))),
words AS (SELECT doc_id, row_number() OVER () AS unit, string_split(u, ' ') AS w FROM units WHERE contains(u, ' ')),
short AS (SELECT doc_id, unit, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM words WHERE len(w) <= 60),
scored AS (
  SELECT doc_id, unit, name, 2.0 * len(list_intersect(list_distinct(p), pairs)) / (len(p) + len(pairs)) AS dice FROM short, templates),
best AS (
  SELECT doc_id, unit, name, dice FROM scored WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dice DESC, name) = 1)
SELECT d.doc_id, count(b.unit) AS n_licences, first(b.name ORDER BY b.dice DESC, b.name) AS best_licence,
       CAST(max(b.dice) AS DOUBLE) AS best_dice, coalesce(string_agg(DISTINCT b.name, ',' ORDER BY b.name), '') AS licences
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id GROUP BY d.doc_id"""
