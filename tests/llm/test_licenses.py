import hashlib
import re

from failurelens.llm import licenses as X

CLEAN = re.compile(r"[^\w\s]|_")


def canon(t):
    """The docstring's normal form for ASCII texts."""
    t = (t or "").lower()
    lines = [ln for ln in t.split("\n") if not re.match(r"[^a-z0-9]*(copyright|\(c\)|all rights reserved)", ln)]
    t = " ".join(CLEAN.sub(" ", "\n".join(lines)).split())
    for a, b in X.SPELLINGS:
        t = t.replace(a, b)
    return t


def test_whole_texts_and_notices(make_docs, clash):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + X.MIT_GRANT
    rows = [(1, mit), (2, mit.upper().replace(",", " ;")), (3, X.MIT_GRANT + " but not for evil"), (4, None), (5, ""),
            (6, "Body text.\nReleased under the MIT Licence.\n# Licensed under CC BY-NC 4.0.\nmore"),
            (7, "Copyright 2020 A\n(c) 2021 B\n" + X.APACHE_HEADER), (8, "Mit.\nISC"), (1, mit),
            (9, "SPDX-License-Identifier: GPL-3.0-or-later"), (None, X.ZLIB_TEXT), (10, "word " * 30_000)]
    got = X.license_report(clash(make_docs(rows))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].license_id for i in (1, 2, 3, 4, 5, 7, 8, None)] == [
        "MIT", "MIT", None, None, None, "Apache-2.0", None, "Zlib"]
    assert by_id[6].notices == "CC-BY-NC-4.0,MIT" and by_id[6].license_id is None
    assert by_id[9].license_id == "GPL-3.0" and by_id[8].notices == ""
    assert by_id[1].notices == "MIT"  # its title line
    for i, t in rows:
        assert by_id[i].canonical_sha256 == hashlib.sha256(canon(t).encode()).hexdigest()


def test_empty(make_docs):
    assert X.license_report(make_docs([])).collect() == []
