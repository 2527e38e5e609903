"""Call sites from source text to edges: receivers, own objects, imported names; policies and root types."""

import pytest

from cairn.api import Graph
from cairn.sources import contracts, infra

FILES = {
    "a/app.py": "from .store import load\n\ndef run(x):\n    load()\n    x.load()\n    x.save()\n    y.solo()\n    twin()\n\nclass A:\n    def go(self):\n        self.stop()\n        self.missing()\n    def stop(self):\n        pass\n",
    "a/store.py": "def load():\n    pass\n\nclass Box:\n    def save(self):\n        pass\n",
    "a/one.py": "def twin():\n    pass\n\ndef solo():\n    pass\n",
    "a/two.py": "def twin():\n    pass\n",
    "w/c.ts": 'import { log } from "./log";\nclass V { show() { this.draw(); log(); other.draw(); far(); } draw() { } }',
    "w/log.ts": "export function log() { }\nexport function far() { }",
    "r/lib.rs": "struct P;\nimpl P { fn make() { } fn go(&self) { self.step(); Self::make(); helper(); } fn step(&self) { } }\nfn f() { P::make(); P::lost(); }",
    "r/util.rs": "fn helper() { }",
}


@pytest.fixture(scope="module")
def called(spark):
    graph = Graph.of_files(spark.createDataFrame(list(FILES.items()), "path string, text string"), "p")
    short = lambda u: u.split("|")[2].split("/")[-1].split(".")[0] + ":" + u.split("|")[3]
    return {(short(e.src), short(e.dst)): (e.provenance, round(e.confidence, 2)) for e in graph.edges.where("kind = 'Calls'").collect()}


def test_python(called):
    assert called[("app:run", "store:load")] == ("Inferred", 0.8)  # the imported name; x.load() is no method anywhere
    assert called[("app:run", "store:Box.save")] == ("Ambiguous", 0.35)
    assert ("app:run", "one:solo") not in called  # a function isn't what another object's method call means
    assert called[("app:run", "one:twin")] == called[("app:run", "two:twin")] == ("Ambiguous", 0.35)
    assert called[("app:A.go", "app:A.stop")] == ("Inferred", 0.8)


def test_typescript(called):
    assert called[("c:V.show", "c:V.draw")] == ("Inferred", 0.8)
    assert called[("c:V.show", "log:log")] == ("Inferred", 0.8)
    assert ("c:V.show", "log:far") not in called  # neither here nor imported


def test_rust(called):
    assert called[("lib:P.go", "lib:P.step")] == called[("lib:P.go", "lib:P.make")] == ("Inferred", 0.8)
    assert called[("lib:f", "lib:P.make")] == ("Extracted", 0.95)
    assert called[("lib:P.go", "util:helper")] == ("Inferred", 0.8)


@pytest.mark.parametrize(
    ("document", "want"),
    [
        ({"Statement": {"Effect": "Maybe", "Action": "s3:Get"}}, ([], ["unknown-effect"])),
        ({"Statement": [{"Action": "s3:Get"}]}, ([], ["unknown-effect"])),
        ({}, ([], ["malformed-policy"])),
        ({"Statement": [{"Effect": "Allow", "Action": ["s3:Get", {"Ref": "x"}]}]}, (["s3:Get"], ["dynamic-action"])),
        ({"Statement": [{"Effect": "Allow"}, {"Effect": "Deny", "Action": "s3:Put"}]}, ([], ["missing-action", "deny-statement"])),
    ],
)
def test_policies(document, want):
    assert infra.policies(document) == want


def test_root_types():
    keys = lambda text: [r[1] for r in contracts.graphql("s.graphql", text)]
    assert keys("schema { query: Root }\ntype Root { a: Int }\ntype Mutation { b: Int }\ntype Query { c: Int }") == ["Query.a", "Mutation.b"]
    assert keys("type Query { a: Int }\nextend type Query { b: Int }") == ["Query.a"]
    assert keys("type Query { a: Int }") == ["Query.a"]
