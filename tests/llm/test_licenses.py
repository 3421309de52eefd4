import math
import random
import textwrap
from collections import Counter

from barloom.llm import licenses as L


def brute(files, threshold=L.THRESHOLD):
    """Cosines of every line with every template, then the nearest licence file."""
    n, df = len(files), Counter()
    for _, t in files:
        df.update(set(L.terms(t or "")))
    vocabulary = {t for _, text in L.TEMPLATES for t in L.terms(text)}

    def vector(text):
        c = Counter(t for t in L.terms(text) if t in vocabulary)
        return {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}

    def cosine(a, b):
        dot = sum(w * b.get(t, 0) for t, w in a.items())
        return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if a and b else 0

    weighted = [(name, vector(text)) for name, text in L.TEMPLATES]
    own = []
    for p, t in files:
        if "SPDX-License-Identifier: " in (t or ""):
            own.append((p, t.split("SPDX-License-Identifier: ")[1].split()[0], 1.0))
            continue
        score, name = max((cosine(vector(line), v), name) for line in (t or "").split("\n") for name, v in weighted)
        own.append((p, name, round(score, 6)) if score >= threshold else (p, None, 0.0))
    holders = {}
    for p, name, score in own:
        d, _, base = (p or "").rpartition("/")
        if p and name and base.lower().startswith(("license", "licence", "copying", "notice", "unlicen")):
            holders[d] = min(holders.get(d, ((1, ""), "")), ((-score, p), name))
    out = []
    for p, name, score in own:
        got, source = name, None
        if not name and p is not None:
            d = p.rpartition("/")[0]
            while True:
                if d in holders:
                    got, source = holders[d][1], d
                    break
                if not d:
                    break
                d = d.rpartition("/")[0]
        out.append((p, name, score, got, source))
    return sorted(out, key=str)


def run(files):
    return sorted((tuple(r) for r in L.inherit(L.scan(files)).collect()), key=str)


def same(a, b):
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
    assert all(abs(x[2] - y[2]) < 1e-5 for x, y in zip(a, b, strict=True))


def test_trees_of_files(spark):
    notice = dict((n, t) for n, t in L.TEMPLATES if t.startswith(("Licensed", "Released")))
    rows = [("LICENSE", notice["MIT"]), ("a/x.py", "code"), ("a/b/COPYING", "text\n" + notice["Apache-2.0"]), ("a/b/c/y.py", "# the of under version"), ("a/b/c/z.py", "// licensed under CC BY-NC 4.0"), ("a/bb/w.py", ""), ("d/notice.txt", "nothing"), ("d/v.py", None), ("q/s.py", "# SPDX-License-Identifier: ISC\nx"), ("top.py", "x"), (None, "Released under the MIT License."), (None, None), ("a/x.py", "code"), ("long.py", "word the license of " * 30000)]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")
    same(run(files), brute(rows))
    assert run(files.limit(0)) == []


def test_documents(spark, sf):
    files = L.document_paths(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("doc_id")
    rows = [tuple(r) for r in files.collect()]
    got = run(files)
    same(got, brute(rows))
    text = {p: t for p, t in rows}
    for phrase, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("under the Apache License, Version 2.0.", "Apache-2.0"), ("GNU General Public License, version 3.", "GPL-3.0")):
        there = [r for r in got if phrase in text[r[0]]]
        assert there and all(r[1] == name for r in there)
    assert all(r[1] is None or "icense" in text[r[0]] for r in got)


def wrapped(text, mark, width=76):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_wrapped_and_mid_paragraph_notices(spark):
    of = lambda name, start: next(t for n, t in L.TEMPLATES if n == name and start in t)
    mit = of("MIT", "Permission") + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
    gpl = "This program is free software: " + of("GPL-3.0", "redistribute") + ", or (at your option) any later version."
    bsd = of("BSD-2-Clause", "Redistribution") + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    third = " 3. " + of("BSD-3-Clause", "Neither") + "."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'
    head = "Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble"
    files = {
        "m/LICENSE": ("Copyright (c) 2020 Someone\n\n" + wrapped(mit, ""), "MIT"),
        "m/x.py": ("import os", None),
        "g.py": (wrapped(gpl, "# ") + "\n\nimport os\n", "GPL-3.0"),
        "b2.c": ("/*\n" + wrapped(bsd, " * ", 50) + "\n */\nint x;\n", "BSD-2-Clause"),
        "b3.c": ("/*\n" + wrapped(bsd + third, " * ", 50) + "\n */\nint x;\n", "BSD-3-Clause"),
        "i.c": (wrapped("Copyright (c) Someone. " + of("ISC", "Permission") + ".", "// ", 60) + "\nint y;\n", "ISC"),
        "a.go": (wrapped(apache, "// ", 70) + "\n\npackage main\n", "Apache-2.0"),
        "g2.py": (wrapped(gpl.replace("version 3", "version 2"), "# ", 60), "GPL-2.0"),
        "lg.py": (wrapped(gpl.replace("General", "Lesser General"), "# ", 60), "LGPL-3.0"),
        "mp.js": ("/* " + wrapped(of("MPL-2.0", "Source Code") + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", " * ", 55) + " */", "MPL-2.0"),
        "h1/LICENSE": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n " + wrapped(head, " "), "GPL-3.0"),
        "h1/x.c": ("int main() { return 0; }", None),
        "h2/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n " + wrapped(head, " "), "GPL-2.0"),
        "h3/COPYING": ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n " + wrapped(head, " "), "LGPL-3.0"),
        "h4/COPYING": ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n " + wrapped(head, " "), "AGPL-3.0"),
        "h5/LICENSE": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.", "Apache-2.0"),
        "h6/LICENSE": ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n", "MPL-2.0"),
        "t1.rs": ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nfn main() {}", "MIT"),
        "t2.rs": ("// SPDX-License-Identifier: whatever you like\nfn main() {}", None),
        "t3.rs": ("// SPDX-License-Identifier: LicenseRef-Own\nfn main() {}", "LicenseRef-Own"),
        "p.md": ("The tool reads a table and writes another. Released under the MIT License. Bug reports and patches of every kind are welcome in the tracker, as is help with the manual.", "MIT"),
        "s/COPYING": ("Released\n\nSomeone here 2020\n\nunder the\n\nwell known good old\n\nMIT\n\nsort\n\nLicense", "MIT"),
        "s/plain.txt": ("Released\n\nSomeone here 2020\n\nunder the\n\nwell known good old\n\nMIT\n\nsort\n\nLicense", None),
        "n.txt": ("A permission was granted to any person in the file, and the software is free to use under conditions that are met.", None),
    }
    got = {r[0]: r for r in run(spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string"))}
    assert {p: r[1] for p, r in got.items()} == {p: name for p, (_, name) in files.items()}
    assert got["m/x.py"][3:] == ("MIT", "m") and got["h1/x.c"][3:] == ("GPL-3.0", "h1") and got["s/plain.txt"][3:] == ("MIT", "s")


def test_every_run_of_terms():
    """Against all runs of each template's length, without the prefilter."""
    rng = random.Random(5)
    vocabulary = sorted({t for _, text in L.TEMPLATES for t in L.terms(text)})
    matcher = L.Matcher(1000, {t: rng.choice([0, 3, 50, 900]) for t in vocabulary})
    some = 0
    for _ in range(200):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = L.terms(rng.choice(L.TEMPLATES)[1])
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            words += part[: rng.randint(1, 60)] + [rng.choice([*vocabulary, "other", "word"]) for _ in range(rng.randint(0, 9))]
        want = set()
        for k, (_, template) in enumerate(matcher.vectors):
            size = matcher.lengths[k]
            for s in range(max(len(words) - size, 0) + 1):
                v = matcher.vector(words[s : s + size])
                if sum(w * template.get(t, 0) for t, w in v.items()) >= L.THRESHOLD:
                    want.add((k, s))
        assert want <= set(matcher.runs(words))
        name, score = matcher.best("\n".join(words))
        assert (name is not None) == bool(want) or score >= L.THRESHOLD
        some += len(want) > 0
    assert 50 < some < 200


def test_ids_of_the_query_are_those_of_the_rows(spark, tmp_path):
    rows = [(None, "x", "site-5"), (5, "x", "site-5"), (None, "x", None), (500, "Released under the MIT License.", "site-5"), (500, "Released under the MIT License.", "site-5")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.license, r.effective_license) for r in L.contract(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, None, None), (None, None, None), (5, None, None), (500, "MIT", "MIT"), (500, "MIT", "MIT")], key=str)


def test_own_templates(spark):
    own = (("House", "This table may be read by members of the house."),)
    files = spark.createDataFrame([("a", "Note: this table may be\nread by members of the house.", 7), ("b", "Released under the MIT License.", 8)], "path string, text string, n int")
    got = {r.path: (r.license, r.n) for r in L.scan(files, templates=own, keep=("n",)).collect()}
    assert got == {"a": ("House", 7), "b": (None, 8)}
