"""Linkers and extractors whose result or memory grew faster than their input: same results, no pairs in windows, sums or exchanges."""

from collections import Counter

import pytest

from cairn.operators import code_links, infra_links, linkers, overlay
from cairn.sources import extract, python_code

from .test_fan_out import unmoved


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_policies_meet_roles_once(spark):
    roles = spark.createDataFrame([("a", "t", "x"), ("a", "t", "x"), ("b", "t", "x"), ("b", "t", "y"), (None, "t", "z")], "uid string, template string, logical_id string")
    policies = spark.createDataFrame([("p", "t", ["x", "y", "x"], ["s3"]), ("p", "t", ["x"], ["s3"]), ("q", "t", ["z"], ["s3"]), ("r", "t", [], ["s3"]), ("s", "u", ["x"], ["s3"])], "uid string, template string, role_ids array<string>, granted array<string>")
    met, lost = infra_links.attach_policies(policies, roles)
    assert Counter((r.role, r.policy) for r in met.collect()) == Counter([("a", "p"), ("b", "p")])
    assert lost.first()[0] == 3
    assert plan(met).count("Generate inline") == 2 and not unmoved(met)  # only roles with several ids are looked through
    root = met._jdf.queryExecution().optimizedPlan()
    first = root.children().apply(0)
    while first.nodeName() in ("Union", "Project", "Filter"):
        first = first.children().apply(0)
    assert first.nodeName() == "Generate"


def test_mentions_of_a_section(spark):
    targets = [("u1", "a.py", "m.f", "f", False), ("u2", "b.py", "n.f", "f", False), ("u3", "c.py", "<module>", "c", True), ("u4", "d.py", "g", "g", False), ("u4", "e.py", "g", "g", False)]
    refs = [("s1", "x.md", "f", "code"), ("s2", "a.py", "f", "code"), ("s3", "x.md", "m.f", "fence"), ("s3", "x.md", "f", "code"), ("s4", "x.md", "c.py", "path"), ("s4", "x.md", "c.py", "code"), ("s5", "d.py", "g", "code"), ("s6", "x.md", "m.f", "code"), ("s6", "x.md", "m.f", "fence"), (None, "x.md", "m.f", "code")]
    met = linkers.link_mentions(spark.createDataFrame(refs, "section string, doc string, ref string, form string"), spark.createDataFrame(targets, "uid string, path string, fqn string, name string, path_bearing boolean"))
    got = Counter((r.section, r.uid, r.tier, r.provenance, round(r.confidence, 2)) for r in met.collect())
    assert got == Counter([
        ("s1", "u1", 3, "Ambiguous", 0.35), ("s1", "u2", 3, "Ambiguous", 0.35), ("s2", "u2", 3, "Ambiguous", 0.35), ("s3", "u1", 2, "Inferred", 0.8), ("s3", "u2", 3, "Ambiguous", 0.35),
        ("s4", "u3", 1, "Extracted", 0.95), ("s5", "u4", 2, "Ambiguous", 0.35), ("s6", "u1", 2, "Ambiguous", 0.35), (None, "u1", 2, "Inferred", 0.8),
    ])


def test_handlers_without_pairs(spark):
    routes = spark.createDataFrame([(1, "f", "h", "<module>"), (2, "f", "no", "<module>"), (3, "g", "h", "<module>"), (4, "f", "k", "z")], "route long, file string, handler string, enclosing_fqn string")
    symbols = spark.createDataFrame([("a", "f", "h", "A.h"), ("b", "f", "h", "h"), ("m", "f", "-", "<module>"), ("c", "f", "k", "B.k"), ("d", "f", "k", "A.k")], "uid string, file string, name string, fqn string")
    met = code_links.handler_or_enclosing(routes, symbols)
    assert {(r.route, r.uid) for r in met.collect()} == {(1, "b"), (2, "m"), (4, "d")}
    assert "Window" not in plan(met)


def test_differential_without_joins(spark):
    found = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (4, None)], "site long, uid string")
    told = spark.createDataFrame([(1, "b"), (2, "c"), (3, "a"), (None, "a"), (4, None)], "site long, uid string")
    out = overlay.differential(found, told)
    assert Counter(tuple(r) for r in out.collect()) == Counter([(1, 2, True, True), (2, 1, True, False), (3, 0, True, False), (None, 1, False, False), (None, 0, True, False), (4, 1, True, False)])
    assert "Join" not in plan(out)


PARTS = '"""x\ndef no():\n"""\nimport a\n\n@a.get("/x")\ndef f():\n    g("""\ndef no(): h()\n""")\n\nif a:\n    k()\nelse:\n    l()\nclass C:\n    def m(self):\n        self.n()\r\n    def n(self): pass\ntry:\n    o()\nexcept E:\n    pass\nasync def p(): q()\nr = (\n1)\n'


@pytest.mark.parametrize("size", [1, 20, 60, 10_000])
def test_files_are_parsed_in_pieces(monkeypatch, size):
    whole = python_code.parse("a.py", PARTS)
    monkeypatch.setattr(python_code, "PIECE", size)
    pieces = [t for t, _ in python_code.trees(PARTS)]
    assert python_code.parse("a.py", PARTS) == whole
    assert (len(pieces) > 3) == (size < 60) or size == 60
    with pytest.raises(ValueError, match=r"line 28\)"):
        python_code.parse("a.py", PARTS + "\ndef bad(:\n    pass\n")


def test_one_error_for_a_file_that_breaks_late(spark, monkeypatch):
    monkeypatch.setattr(python_code, "PIECE", 10)
    monkeypatch.setattr(extract, "ROWS", 2)
    files = spark.createDataFrame([("a.py", PARTS + "def bad(:\n"), ("b.py", "def f():\n    g()\n    h()\n")], "path string, text string")
    got = Counter((r.file, r.record) for r in python_code.facts(files).collect())
    assert got == Counter({("a.py", None): 1, ("b.py", "symbol"): 1, ("b.py", "call"): 2})
