"""Resources of infrastructure templates: CloudFormation and SAM, Terraform, its plans, Terragrunt units."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from .contracts import value_of
from .extract import per_file

#: references: (property, grade, ids); grade is Resource (plain), Inferred (recovered from an expression) or Multi (one id per branch).
RESOURCES = "logical_id string, type string, kind string, handler string, code_uri string, refs array<struct<property:string,grade:string,ids:array<string>>>, type_name string, field_name string, granted array<string>, opaque array<string>"
# Types of resources and their kinds; properties that refer to others.
KINDS = {
    "AWS::Lambda::Function": "LambdaFn", "AWS::Serverless::Function": "LambdaFn", "AWS::IAM::Role": "IamRole", "AWS::AppSync::GraphQLApi": "AppSyncApi",
    "AWS::AppSync::Resolver": "AppSyncResolver", "AWS::AppSync::DataSource": "AppSyncDataSource", "AWS::IAM::Policy": "Policy", "AWS::IAM::ManagedPolicy": "Policy",
    "aws_lambda_function": "LambdaFn", "aws_iam_role": "IamRole", "aws_appsync_graphql_api": "AppSyncApi", "aws_appsync_resolver": "AppSyncResolver", "aws_appsync_datasource": "AppSyncDataSource", "aws_iam_role_policy": "Policy",
}
REFERS = {"role": ("Role", "ServiceRoleArn", "Roles", "role", "service_role_arn"), "api": ("ApiId", "api_id"), "data_source": ("DataSourceName", "data_source"), "lambda": ("LambdaConfig", "lambda_config")}


def grade(v) -> tuple[str, list[str]] | None:
    """How plainly a template value names a resource, and which."""
    if isinstance(v, dict) and len(v) == 1:
        (f, x), *_ = v.items()
        if f == "Ref" and isinstance(x, str):
            return "Resource", [x]
        if f == "Fn::GetAtt":
            return "Resource", [x[0] if isinstance(x, list) else str(x).split(".")[0]]
        if f == "Fn::If" and isinstance(x, list) and len(x) == 3:
            ids = [i for part in x[1:] if (g := grade(part)) for i in g[1]]
            return ("Multi" if len(set(ids)) > 1 else "Inferred", list(dict.fromkeys(ids))) if ids else None
        if f == "Fn::Sub":
            text = x[0] if isinstance(x, list) else x
            ids = list(dict.fromkeys(i.split(".")[0] for i in re.findall(r"\$\{([A-Za-z][\w.]*)\}", str(text)) if not i.startswith("AWS")))
            return ("Inferred", ids) if len(ids) == 1 else None
        if f == "Fn::Join" and isinstance(x, list) and len(x) == 2:
            ids = list(dict.fromkeys(i for part in x[1] if (g := grade(part)) for i in g[1])) if isinstance(x[1], list) else []
            return ("Inferred", ids) if len(ids) == 1 else None
    return None


def policies(document) -> tuple[list[str], list[str]]:
    """Actions a policy plainly allows, and the reasons why the rest is opaque."""
    granted, opaque = [], []
    statements = document.get("Statement") if isinstance(document, dict) else None
    if not isinstance(statements, (list, dict)):
        return [], ["malformed-policy"]
    for s in statements if isinstance(statements, list) else [statements]:
        effect = s.get("Effect") if isinstance(s, dict) else None
        if effect == "Deny":
            opaque.append("deny-statement")
        elif effect != "Allow":  # neither is said to grant nor to deny
            opaque.append("unknown-effect")
        elif "NotAction" in s:
            opaque.append("not-action")
        elif "Action" not in s:
            opaque.append("missing-action")
        else:
            for a in s["Action"] if isinstance(s["Action"], list) else [s["Action"]]:
                if isinstance(a, str):
                    granted.append(a)
                    opaque += ["wildcard"] if "*" in a else []
                else:
                    opaque.append("dynamic-action")
        opaque += ["condition"] if isinstance(s, dict) and "Condition" in s else []
    return list(dict.fromkeys(granted)), list(dict.fromkeys(opaque))


# Policy templates of the serverless transform, and the actions each stands for.
SAM = {
    "DynamoDBCrudPolicy": ["dynamodb:GetItem", "dynamodb:DeleteItem", "dynamodb:PutItem", "dynamodb:Scan", "dynamodb:Query", "dynamodb:UpdateItem", "dynamodb:BatchWriteItem", "dynamodb:BatchGetItem", "dynamodb:DescribeTable", "dynamodb:ConditionCheckItem"],
    "DynamoDBReadPolicy": ["dynamodb:GetItem", "dynamodb:Scan", "dynamodb:Query", "dynamodb:BatchGetItem", "dynamodb:DescribeTable"],
    "DynamoDBWritePolicy": ["dynamodb:PutItem", "dynamodb:UpdateItem", "dynamodb:BatchWriteItem"],
    "S3ReadPolicy": ["s3:GetObject", "s3:ListBucket", "s3:GetBucketLocation", "s3:GetObjectVersion", "s3:GetLifecycleConfiguration"],
    "S3CrudPolicy": ["s3:GetObject", "s3:ListBucket", "s3:GetBucketLocation", "s3:GetObjectVersion", "s3:PutObject", "s3:PutObjectAcl", "s3:GetLifecycleConfiguration", "s3:PutLifecycleConfiguration", "s3:DeleteObject"],
    "SQSSendMessagePolicy": ["sqs:SendMessage*"],
    "SQSPollerPolicy": ["sqs:ChangeMessageVisibility", "sqs:ChangeMessageVisibilityBatch", "sqs:DeleteMessage", "sqs:DeleteMessageBatch", "sqs:GetQueueAttributes", "sqs:ReceiveMessage"],
    "SNSPublishMessagePolicy": ["sns:Publish"],
    "LambdaInvokePolicy": ["lambda:InvokeFunction"],
    "KMSDecryptPolicy": ["kms:Decrypt"],
    "SSMParameterReadPolicy": ["ssm:DescribeParameters", "ssm:GetParameters", "ssm:GetParameter", "ssm:GetParametersByPath"],
    "AWSSecretsManagerGetSecretValuePolicy": ["secretsmanager:GetSecretValue"],
}


def function_policies(listed) -> tuple[list[str], list[str]]:
    """The same of a serverless function's Policies: names of managed policies and unknown templates are reasons, never guesses."""
    granted, opaque = [], []
    for x in listed if isinstance(listed, list) else [listed]:
        if isinstance(x, str):
            more = [], [f"managed-policy:{x}"]
        elif isinstance(x, dict) and ("Statement" in x or "PolicyDocument" in x):
            more = policies(x if "Statement" in x else x["PolicyDocument"])
        elif isinstance(x, dict) and len(x) == 1:
            (name,) = x
            more = (SAM[name], []) if name in SAM else ([], [f"sam-template:{name}"])
        else:
            more = [], ["dynamic-policy"]
        granted, opaque = granted + more[0], opaque + more[1]
    return list(dict.fromkeys(granted)), list(dict.fromkeys(opaque))


def _refs(properties: dict, how) -> list[dict]:
    out = []
    for name, keys in REFERS.items():
        for k in keys:
            v = properties.get(k)
            if isinstance(v, dict) and k in ("LambdaConfig", "lambda_config"):
                v = v.get("LambdaFunctionArn") or v.get("function_arn")
            for part in v if isinstance(v, list) else [v]:
                if g := how(part):
                    out.append({"property": name, "grade": g[0], "ids": g[1]})
    return out


def cloudformation(path: str, text: str) -> list[tuple]:
    if "Resources" not in text:
        return []
    doc = value_of(text)
    resources = doc.get("Resources") if isinstance(doc, dict) else None
    if not isinstance(resources, dict):
        return []
    if not any(isinstance(r, dict) and str(r.get("Type", "")).startswith("AWS::") for r in resources.values()):
        return []
    rows = []
    for name, r in resources.items():
        if not isinstance(r, dict) or not isinstance(r.get("Type"), str):
            raise ValueError(f"resource {name} has no type")
        p = r.get("Properties") or {}
        granted, opaque = [], []
        serverless = r["Type"] == "AWS::Serverless::Function"
        listed = p.get("Policies") if isinstance(p.get("Policies"), list) and not serverless else []
        if serverless and p.get("Policies") is not None:
            granted, opaque = function_policies(p["Policies"])
        for d in [p.get("PolicyDocument"), *((x.get("PolicyDocument") or x) if isinstance(x, dict) else None for x in listed)]:
            if isinstance(d, dict):
                a, b = policies(d)
                granted, opaque = granted + a, opaque + b
        rows.append((name, r["Type"], KINDS.get(r["Type"], "CloudResource"), p.get("Handler") if isinstance(p.get("Handler"), str) else None, p.get("CodeUri") if isinstance(p.get("CodeUri"), str) else None,
                     _refs(p, grade), p.get("TypeName"), p.get("FieldName"), granted, opaque))
    return rows


_HCL = re.compile(r'\s+|#[^\n]*|//[^\n]*|/\*.*?\*/|<<-?(?P<tag>\w+)\n.*?\n\s*(?P=tag)\b|(?P<string>"(?:\\.|\$\{[^}]*\}|[^"\\])*")|(?P<word>[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*|\[[^\]\n]*\])*)|(?P<mark>.)', re.S)


def _blocks(text: str):
    """Top blocks of a text in HCL: kind, labels, attributes. An attribute's value is a string in quotes, a word, or all of its expression; those of nested blocks are under block.attribute."""
    ts = [(m.lastgroup, m[0]) for m in _HCL.finditer(text) if m.lastgroup in ("string", "word", "mark")]
    i = 0
    while i < len(ts):
        if ts[i][0] != "word":
            i += 1
            continue
        kind, labels, i = ts[i][1], [], i + 1
        while i < len(ts) and ts[i][0] in ("string", "word"):
            labels.append(ts[i][1].strip('"'))
            i += 1
        if i >= len(ts) or ts[i][1] != "{":
            continue
        i, names, found = i + 1, [], {}
        while i < len(ts) and (names or ts[i][1] != "}"):
            t = ts[i][1]
            if t == "}":
                names.pop()
            elif ts[i][0] == "word" and i + 1 < len(ts) and ts[i + 1][1] == "=":
                depth, k, parts = 0, i + 2, []
                while k < len(ts):
                    v = ts[k][1]
                    if depth == 0 and parts and (v == "}" or ts[k][0] == "word" and k + 1 < len(ts) and ts[k + 1][1] in ("=", "{") and parts[-1] not in ("?", ":", ",", "+", "=")):
                        break
                    depth += (v in "([{") - (v in ")]}") if len(v) == 1 else 0
                    parts.append(v)
                    k += 1
                found[".".join([*names, t])] = " ".join(parts)
                i = k
                continue
            elif ts[i][0] == "word":
                k = i + 1
                while k < len(ts) and ts[k][0] == "string":
                    k += 1
                if k < len(ts) and ts[k][1] == "{":
                    names.append(t)
                    i = k
            elif t == "{":
                names.append("_")
            i += 1
        if i >= len(ts):
            raise ValueError(f"block {kind} doesn't close")
        yield kind, labels, found
        i += 1


def _hcl_grade(v: str | None):
    if not isinstance(v, str):
        return None
    ids = list(dict.fromkeys(".".join(i.split(".")[:2]) for i in re.findall(r"\b(?!var\.|local\.|data\.|module\.|each\.|path\.)([a-z][a-z0-9]*_\w+\.\w[\w-]*)", v)))
    if not ids:
        return None
    if re.fullmatch(r"[\w.\[\]\"-]+", v):
        return "Resource", ids
    return ("Multi" if "?" in v and len(ids) > 1 else "Inferred", ids) if len(ids) == 1 or "?" in v else None


def terraform(path: str, text: str) -> list[tuple]:
    rows = []
    for kind, labels, found in _blocks(text):
        if kind != "resource" or len(labels) != 2:
            continue
        plain = lambda k, found=found: v[1:-1] if (v := found.get(k, "")).startswith('"') and v.endswith('"') and "${" not in v else None
        properties = {**found, "lambda_config": {"function_arn": found.get("lambda_config.function_arn")}}
        rows.append((".".join(labels), labels[0], KINDS.get(labels[0], "CloudResource"), plain("handler"), plain("filename") or plain("source_dir"), _refs(properties, _hcl_grade), plain("type"), plain("field"), [], []))
    return rows


def plan(path: str, text: str) -> list[tuple]:
    """Planned resources of all modules, with the references that the configuration states."""
    doc = json.loads(text)
    if not isinstance(doc, dict) or "planned_values" not in doc:
        return []
    stated: dict[str, dict] = {}

    def configured(module, prefix):
        for r in module.get("resources", []):
            stated[f"{prefix}{r['type']}.{r['name']}"] = r.get("expressions", {})
        for name, call in module.get("module_calls", {}).items():
            configured(call.get("module", {}), f"{prefix}module.{name}.")

    configured(doc.get("configuration", {}).get("root_module", {}), "")
    rows = []

    def planned(module):
        for r in module.get("resources", []):
            if r.get("mode", "managed") != "managed":
                continue
            values, bare = r.get("values") or {}, re.sub(r"\[[^\]]*\]", "", r["address"])
            prefix = bare[: len(bare) - len(f"{r['type']}.{r['name']}")]

            def how(e, prefix=prefix):
                names = e.get("references", []) if isinstance(e, dict) else []
                ids = list(dict.fromkeys(prefix + ".".join(n.split(".")[:2]) for n in names if not n.startswith(("var.", "local.", "data.", "module.", "each."))))
                return ("Resource" if len(ids) == 1 else "Multi", ids) if ids else None

            nested = stated.get(bare, {})
            nested = {k: ({"function_arn": v[0].get("function_arn")} if k == "lambda_config" and isinstance(v, list) and v else v) for k, v in nested.items()}
            rows.append((bare, r["type"], KINDS.get(r["type"], "CloudResource"), values.get("handler"), values.get("filename"), _refs(nested, how), values.get("type"), values.get("field"), [], []))
        for child in module.get("child_modules", []):
            planned(child)

    planned(doc["planned_values"].get("root_module", {}))
    return rows


def units(path: str, text: str) -> list[tuple]:
    """name, config_path of the dependencies of a Terragrunt unit that are literal."""
    rows = []
    for kind, labels, found in _blocks(text):
        v = found.get("config_path", "")
        if kind == "dependency" and v.startswith('"') and "${" not in v:
            rows.append((labels[0] if labels else None, v[1:-1]))
    return rows


def _parse(path: str, text: str) -> list[tuple]:
    if path.endswith((".tf", ".tofu")):
        return terraform(path, text)
    if path.endswith(".json") and "planned_values" in text:
        return plan(path, text)
    if re.search(r"""^\s*["']?(openapi|swagger)["']?\s*:""", text, re.M):  # a contract, not a template
        return []
    return cloudformation(path, text)


def resources(files: DataFrame) -> DataFrame:
    """file, error and the resources of templates; a malformed one is one row with its error."""
    return per_file(files, _parse, RESOURCES)


def dependencies(files: DataFrame) -> DataFrame:
    """file, error, name, config_path of Terragrunt units."""
    return per_file(files, units, "name string, config_path string")
