"""Extraction from source files, contracts, schemas and templates; files and versions."""

import pytest

from cairn.operators import code_links, infra_links
from cairn.sources import brace_code, catalog, contracts, ddl, files, infra, python_code


def of(rows, record):
    return [r for r in rows if r[0] == record]


def test_python_facts():
    rows = python_code.parse("a.py", 'from .m import x as y\nclass Query:\n    """Doc."""\n    __tablename__ = "t"\n    def resolve_all_users(self):\n        return self.go(y())\n@app.route("/a/<id>", methods=["GET", "POST"])\ndef h(id):\n    requests.get(f"http://x/{id}")\n    db.execute("select 1 from t")\n    db.execute(f"select {id} from t")\nurlpatterns = [path("users/", views.users)]\n')
    assert [(r[1], r[3], r[5]) for r in of(rows, "symbol")] == [("Class", "Query", "Doc."), ("Method", "Query.resolve_all_users", None), ("Function", "h", None)]
    assert [(r[1], r[2], r[5]) for r in of(rows, "route")] == [("GET", "h", "/a/<id>"), ("POST", "h", "/a/<id>"), ("<ANY>", "users", "/users")]
    assert [(r[1], r[2], r[5]) for r in of(rows, "http")] == [("GET", "Template", "http://x/{}")]
    assert [r[5] for r in of(rows, "sql")] == ["select 1 from t"]
    assert [r[5] for r in of(rows, "orm")] == ["t"] and [r[5] for r in of(rows, "resolver")] == ["Query.allUsers"]
    with pytest.raises(ValueError):
        python_code.parse("a.py", "def (")


def test_typescript_facts():
    rows = brace_code.parse("a.ts", 'import { a as b } from "./x";\n// call()\n@Entity("users")\nexport class User { save(): void { helper(1); this.log("x()"); } }\ninterface I { bar(): void; }\nconst f = async (x) => { inner(x); };\napp.get("/u/:id", getUser);\nfetch(`/v1/${a}`, { method: "POST" });\nconst q = gql`query { users }`;')
    assert [(r[1], r[3]) for r in of(rows, "symbol")] == [("Class", "User"), ("Method", "User.save"), ("Interface", "I"), ("Method", "I.bar"), ("Function", "f")]
    assert [(r[2], r[4], r[5]) for r in of(rows, "call")] == [("helper", "User.save", None), ("log", "User.save", "this"), ("inner", "f", None), ("get", "<module>", "app"), ("fetch", "<module>", None)]
    assert [(r[1], r[2], r[5]) for r in of(rows, "route")] == [("GET", "getUser", "/u/:id")]
    assert [(r[1], r[5]) for r in of(rows, "http")] == [("POST", "/v1/{}")] and [r[5] for r in of(rows, "orm")] == ["users"] and [r[5] for r in of(rows, "gql")] == ["query { users }"]


def test_rust_and_csharp_facts():
    rust = brace_code.parse("a.rs", "use a::{b, c::{d, e as f}};\nimpl<'a> Show for S<'a> { fn new(x: &'a str) -> Self { Self::build(x); print!(1); } }\nfn main() { let s = S::new(1); s.run(); }")
    assert [r[5] for r in of(rust, "import")] == ["a::b", "a::c::d", "a::c::e"]
    assert [(r[1], r[3]) for r in of(rust, "symbol")] == [("Method", "S.new"), ("Function", "main")]
    assert [(r[1], r[2], r[5]) for r in of(rust, "call")] == [("path", "build", "Self"), ("path", "new", "S"), ("member", "run", "s")]
    sharp = brace_code.parse("a.cs", "using A.B;\nnamespace N { class C { public int M(int a) { return Help(a); } void P() => Other.Do(); } }")
    assert [(r[1], r[3]) for r in of(sharp, "symbol")] == [("Module", "N"), ("Class", "C"), ("Method", "C.M"), ("Method", "C.P")]
    assert [(r[2], r[5]) for r in of(sharp, "call")] == [("Help", None), ("Do", "Other")]


@pytest.mark.parametrize("language", ["a.ts", "a.rs", "a.cs"])
@pytest.mark.parametrize("text", ["", "{", "}", "class", "fn", "impl {", "use", "import", '"', "f(", "class A { m(", "/*", "é λ {"])
def test_broken_sources_do_not_stop_a_run(language, text):
    brace_code.parse(language, text)


def test_contracts():
    rows = contracts.parse("a.json", '{"openapi": "3.0.0", "paths": {"/u/{id}": {"get": {"operationId": "getU"}, "post": {}, "x-y": {}}}}')
    assert [(r[1], r[4]) for r in rows] == [("getU", "/u/{}"), ("POST /u/{}", "/u/{}")]
    rows = contracts.parse("a.graphql", 'schema { query: Root }\ntype Root { "d" users(n: Int = 1): [User!]! @a(b: 1) me: User }\ntype User @key(fields: "id") { id: ID! }')
    assert [(r[1], r[6]) for r in rows] == [("Query.users", "d"), ("Query.me", None)]
    assert contracts.documents("q", "query A($x: Int) { users(a: $x) { id } u: me ...F __typename } fragment F on Query { z }") == [("field", "Query.users"), ("field", "Query.me"), ("spread", "F")]
    rows = contracts.parse("a.proto", "package p; service S { rpc A (stream X) returns (Y) { option (x) = {a: 1}; } rpc B (X) returns (stream Y); }")
    assert [(r[1], r[2]) for r in rows] == [("p.S.A", "client_stream"), ("p.S.B", "server_stream")]
    with pytest.raises(ValueError):
        contracts.graphql("a", "type Query { a: ")


def test_schema_is_folded_in_order():
    t = ddl.schema("""create table a.users (id bigint not null, n varchar(20) default 'x;y', primary key (id));
      create table o (id int primary key, u int references users(id), k int, foreign key (k) references users (id));
      alter table o add column z text, drop k; alter table o rename column u to uu; alter table none add x int; -- ; c
      create function f() as $$ a; b $$;""")
    assert list(t) == ["users", "o"] and list(t["o"]["columns"]) == ["id", "uu", "z"] and t["o"]["keys"] == [("uu", "users", "id")]
    assert t["users"]["columns"]["id"] == {"name": "id", "type": "bigint", "nullable": False, "primary": True}
    assert list(ddl.schema("create table a (x int); create table a (y int)")["a"]["columns"]) == ["y"]
    with pytest.raises(ValueError):
        ddl.schema("create table")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select * from a join b on a.x = b.x, c where x in (select y from d)", [("a", "Read"), ("b", "Read"), ("c", "Read"), ("d", "Read")]),
        ("with z as (select 1 from q) insert into t select * from z", [("q", "Read"), ("t", "Write")]),
        ("update a set x = 1 from b", [("a", "Write"), ("b", "Read")]),
        ("delete from k using m", [("k", "Write"), ("m", "Read")]),
        ("select extract(year from ts) from e, s.f", [("e", "Read"), ("f", "Read")]),
        ("", []),
    ],
)
def test_table_references(text, want):
    assert ddl.references(text) == want


def test_templates(spark):
    yaml = "Resources:\n  F:\n    Type: AWS::Serverless::Function\n    Properties: {Handler: a.b, Role: !GetAtt R.Arn}\n  D:\n    Type: AWS::AppSync::DataSource\n    Properties: {ServiceRoleArn: !If [x, !Ref A, !Ref B], LambdaConfig: {LambdaFunctionArn: !Sub '${F.Arn}'}}\n"
    hcl = 'resource "aws_lambda_function" "f" {\n  handler = "a.b"\n  role = aws_iam_role.r.arn\n}\n'
    got = infra.resources(spark.createDataFrame([("t.yaml", yaml), ("m.tf", hcl), ("bad.tf", 'resource "a" "b" {'), ("none.yaml", None)], "path string, text string")).collect()
    refs = {r["logical_id"]: [(x["property"], x["grade"], x["ids"]) for x in r["refs"]] for r in got if r["logical_id"]}
    assert refs == {"F": [("role", "Resource", ["R"])], "D": [("role", "Multi", ["A", "B"]), ("lambda", "Inferred", ["F"])], "aws_lambda_function.f": [("role", "Resource", ["aws_iam_role.r"])]}
    assert [r["file"] for r in got if r["error"]] == ["bad.tf"]
    assert infra.policies({"Statement": [{"Effect": "Allow", "Action": ["a:b", "s3:*"]}, {"Effect": "Deny", "Action": "x"}, {"Effect": "Allow", "NotAction": "y"}]}) == (["a:b", "s3:*"], ["wildcard", "deny-statement", "not-action"])
    assert infra.units("u", 'dependency "v" {\n config_path = "../vpc"\n}\ninclude { path = find() }') == [("v", "../vpc")]


def test_handlers_and_modules(spark):
    lambdas = spark.createDataFrame([("f", "svc/t.yaml", "src/", "app.main"), ("g", "t.yaml", None, "x.y")], "uid string, template string, code_uri string, handler string")
    modules = spark.createDataFrame([("m", "svc/src/app.py"), ("n", "x.ts"), ("o", "x.py")], "uid string, path string")
    assert infra_links.runs(lambdas, modules).collect() == [("f", "m")]
    imports = spark.createDataFrame([("a/b/c.py", "..x"), ("a/b/c.py", "."), ("a/b/c.py", "p.q"), ("a/b/c.py", "os")], "file string, module string")
    there = spark.createDataFrame([("a/x.py",), ("a/b/__init__.py",), ("p/q/__init__.py",)], "path string")
    assert {r["module"]: r["resolved"] for r in code_links.resolve_modules(imports, there).collect()} == {"..x": "a/x.py", ".": "a/b/__init__.py", "p.q": "p/q/__init__.py", "os": None}


def test_files_and_ignores(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "sub/skip/c.py", "node_modules/d.py", "sub/keep.py", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.read(spark, str(tmp_path), ("py",), ["skip/", "keep*", "!keep.py"]).collect()
    assert sorted((r["path"], r["text"]) for r in got) == [("a.py", "a.py"), ("sub/b.py", "sub/b.py"), ("sub/keep.py", "sub/keep.py")]
    listed = spark.createDataFrame([("lib/x.dist-info/RECORD", "sub/b.py,sha,1\n")], "path string, text string")
    assert files.without_vendored(spark.createDataFrame([("lib/sub/b.py",), ("sub/b.py",)], "path string"), listed).collect() == [("sub/b.py",)]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert catalog.version(spark, root) == 0
    assert catalog.save(root, nodes=spark.range(3)) == 1 and catalog.save(root, nodes=spark.range(5)) == 2
    assert catalog.load(spark, root, "nodes").count() == 5 and catalog.load(spark, root, "nodes", 1).count() == 3
    watch = catalog.Watch(spark, root)
    assert watch.refresh("nodes") and not watch.refresh("nodes") and watch.tables["nodes"].count() == 5
