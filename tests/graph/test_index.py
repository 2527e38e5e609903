"""A small repository from files to answers."""

import json

import pytest

from cairn.api import Graph

FILES = {
    "api/openapi.json": '{"openapi": "3.0.0", "paths": {"/users/{id}": {"get": {"operationId": "getUser"}}}}',
    "server/app.py": 'from .store import load\n\n@app.get("/users/<id>")\ndef get_user(id):\n    return load(id)\n',
    "server/store.py": 'class User:\n    __tablename__ = "users"\n\ndef load(id):\n    return db.execute("select * from users")\n',
    "web/client.ts": 'import { log } from "./log";\nexport function show(id) { log(id); return fetch(`/users/${id}`); }',
    "web/log.ts": "export function log(x) { }",
    "db/schema.sql": "create table users (id int primary key, org int references orgs(id)); create table orgs (id int);",
    "docs/guide.md": "# Users\nSee `load` and [the store](server/store.py).\n",
    "infra/template.json": json.dumps({"Resources": {
        "Fn": {"Type": "AWS::Serverless::Function", "Properties": {"Handler": "app.get_user", "CodeUri": "../server", "Role": {"Fn::GetAtt": ["Job", "Arn"]}, "Policies": ["Managed", {"SNSPublishMessagePolicy": {}}, {"OwnPolicy": {}}]}},
        "Job": {"Type": "AWS::IAM::Role", "Properties": {}}, "Api": {"Type": "AWS::AppSync::GraphQLApi", "Properties": {}},
        "Src": {"Type": "AWS::AppSync::DataSource", "Properties": {"ApiId": {"Ref": "Api"}, "LambdaConfig": {"LambdaFunctionArn": {"Fn::GetAtt": ["Fn", "Arn"]}}}},
        "Res": {"Type": "AWS::AppSync::Resolver", "Properties": {"TypeName": "Query", "FieldName": "user", "DataSourceName": {"Ref": "Src"}}},
        "May": {"Type": "AWS::IAM::Policy", "Properties": {"Roles": [{"Ref": "Job"}], "PolicyDocument": {"Statement": [{"Effect": "Allow", "Action": "s3:GetObject"}, {"Effect": "Deny", "Action": "s3:*"}]}}},
    }}),
    "infra/schema.graphql": "type Query { user(id: ID): String }",
    "live/app/terragrunt.hcl": 'dependency "net" {\n  config_path = "../net"\n}\ndependency "far" {\n  config_path = "../far"\n}\n',
    "live/net/terragrunt.hcl": "",
    "bad/template.json": '{"Resources": {"X": {"Type": "AWS::S3::Bucket"}, "Y": {}}}',
    "bad/broken.py": "def (",
    "empty.py": None,
}


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.of_files(spark.createDataFrame(list(FILES.items()), "path string, text string"), "shop")


def test_edges(graph):
    short = lambda u: u.strip("|").split("|")[-1] if not u.endswith("<module>|") else u.split("|")[2]
    got = {(short(e["src"]), e["kind"], short(e["dst"])) for e in graph.edges.collect()}
    assert {
        ("get_user", "Calls", "load"), ("show", "Calls", "log"), ("server/app.py", "Imports", "server/store.py"), ("web/client.ts", "Imports", "web/log.ts"),
        ("get_user", "Produces", "getUser"), ("show", "Consumes", "getUser"), ("load", "Reads", "users"), ("User", "MapsTo", "users"), ("users", "HasColumn", "users.org"),
        ("Fn", "Runs", "server/app.py"), ("Fn", "Assumes", "Job"), ("Src", "Routes", "Fn"), ("Res", "Routes", "Src"), ("Api", "Contains", "Src"), ("Fn", "Produces", "Query.user"),
        ("Fn", "Grants", "sns:Publish"), ("Fn", "Grants", "<opaque:managed-policy:Managed>"), ("Fn", "Grants", "<opaque:sam-template:OwnPolicy>"),
        ("Job", "Grants", "s3:GetObject"), ("Job", "Grants", "<opaque:deny-statement>"), ("live/app", "Routes", "live/net"),
        ("users.org", "ForeignKey", "orgs.id"), ("docs/guide.md#users", "Mentions", "load"), ("docs/guide.md#users", "Mentions", "server/store.py"), ("load", "MemberOf", "server/store.py"),
    } <= got
    names = {(n["kind"], n["name"]) for n in graph.nodes.collect()}
    assert {("LambdaFn", "Fn"), ("CloudAction", "sns:Publish"), ("CloudResource", "live/net")} <= names
    assert not any(x in ("May",) for _, x in names) and not any(dst == "live/far" for _, _, dst in got)


def test_questions(graph, spark, tmp_path):
    reached = {r["name"] for r in graph.impact("load").collect()}
    assert {"get_user", "show", "getUser"} <= reached
    assert {r["bucket"] for r in graph.context("load").collect()} >= {"callers", "reads"}
    assert [(r["path"], r["line"], r["col"]) for r in graph.rename("load", "fetch_user").collect()] == [("server/app.py", 1, 19), ("server/app.py", 5, 11), ("server/store.py", 4, 4)]
    assert graph.search_docs("store").count() == 1 and graph.guidance("load").count() == 1
    with pytest.raises(LookupError):
        graph.impact("nobody")
    assert graph.save(str(tmp_path / "g")) == 1
    again = Graph.load(spark, str(tmp_path / "g"))
    assert again.nodes.count() == graph.nodes.count() and graph.detect_changes(again).isEmpty()
