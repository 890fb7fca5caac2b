"""API discovery over request logs: endpoints, tags, schemas, an interface description."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..sources.shared import written

DEPTH, PROPERTIES, BODIES = 3, 20, 3


def json_schema(data, depth: int = DEPTH) -> dict:
    """A schema of a JSON value: the first item of lists, the first 20 properties, formats of strings."""
    if depth <= 0:
        return {"type": "object"}
    for kinds, name in (((type(None),), "null"), ((bool,), "boolean"), ((int,), "integer"), ((float,), "number")):
        if isinstance(data, kinds):
            return {"type": name} if data is None else {"type": name, "example": data}
    if isinstance(data, str):
        out: dict = {"type": "string"} | ({"example": data} if len(data) < 100 else {})
        if re.match(r"\d{4}-\d{2}-\d{2}", data):
            out["format"] = "date-time" if "T" in data else "date"
        elif re.match(r"https?://", data):
            out["format"] = "uri"
        elif re.fullmatch(r"[^@]+@[^@]+\.[^@]+", data):
            out["format"] = "email"
        return out
    if isinstance(data, list):
        return {"type": "array", "items": json_schema(data[0], depth - 1) if data else {}}
    return {"type": "object", "properties": {k: json_schema(v, depth - 1) for k, v in list(data.items())[:PROPERTIES]}}


@F.pandas_udf(T.StringType())
def infer_schema(body: pd.Series) -> pd.Series:
    """The schema of each JSON text as JSON; null where it is none."""

    def one(text):
        try:
            return json.dumps(json_schema(json.loads(text)), sort_keys=True)
        except (TypeError, ValueError, RecursionError):
            return None

    return pd.Series([one(b) for b in body], dtype=object)


def endpoints(log: DataFrame) -> DataFrame:
    """(method, path, tag, calls, hosts, examples, bodies) of the API calls of a log (url, method, kind, seq, body)."""
    calls = log.filter(urls.is_api_request(F.col("url"), F.col("kind")))
    rows = calls.select("method", urls.template(urls.path(F.col("url"))).alias("path"), urls.netloc(F.col("url")).alias("host"), "url", "seq", "body")
    counted = rows.groupBy("method", "path").agg(F.count(F.lit(1)).alias("calls"), F.array_sort(F.collect_set("host")).alias("hosts"))

    first = Window.partitionBy("method", "path").orderBy("seq")
    few = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= BODIES)
    listed = few.groupBy("method", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "url"))), lambda x: x["url"]).alias("examples"), F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("_n", "body")))), lambda x: x["body"]).alias("bodies"))
    return counted.join(listed, ["method", "path"]).withColumn("tag", urls.tag(F.col("path")))


_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}


def body_fields(log: DataFrame, by: list[str], body: str = "body", depth: int | None = DEPTH) -> DataFrame:
    """(*by, path, types, formats, found, example): what stands at every path of the JSON bodies of a key, all of them.

    Paths are ``$``, ``$.name`` and ``$.name[]`` for the items of an array, down to ``depth`` steps (None: all that there
    are).  ``types`` and ``formats`` are sorted and distinct, ``found`` counts values, ``example`` is the least short text or
    number as text.  Bodies that are no JSON are left out.  A level is one expansion in the JVM; what it finds is
    aggregated at once, so that a path is shuffled once a task and not once a body.
    """
    spark = log.sparkSession
    keys = [f"_key{i}" for i in range(len(by))]  # names of helper columns cannot clash with these
    level = log.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.lit("$").alias("path"), F.try_parse_json(F.col(body)).alias("v")).filter("v is not null")
    if depth is None:
        level = written(level.withColumn("v", F.to_json("v")), "bodies").withColumn("v", F.parse_json("v"))
    found, step = None, 0
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        text = F.try_variant_get("v", "$", "string")
        named = F.coalesce(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[kind], F.lit("other"))
        format_ = F.when(kind == "STRING", F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.when(F.contains(text, F.lit("T")), "date-time").otherwise("date")).when(text.rlike("^https?://"), "uri").when(text.rlike(r"^[^@]+@[^@]+\.[^@]+$"), "email"))
        short = F.when(~kind.isin("OBJECT", "ARRAY", "VOID") & (F.length(text) < 100), text)
        here = level.select(*keys, "path", named.alias("t"), format_.alias("f"), short.alias("e"))
        counted = here.groupBy(*keys, "path", "t", "f").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e"))
        found = counted if found is None else found.unionByName(counted)
        if depth is not None and step >= depth:
            break
        inner = level.filter(kind.isin("OBJECT", "ARRAY")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = inner.select(*keys, F.concat("path", F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), "key"))).alias("path"), F.col("value").alias("v")).filter("v is not null")
        step += 1
        if depth is None and not level.filter(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).isin("OBJECT", "ARRAY")).limit(1).count():
            depth = step
    listed = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  a dozen values at most
    return found.groupBy(*keys, "path").agg(listed("t").alias("types"), listed("f").alias("formats"), F.sum("n").alias("found"), F.min("e").alias("example")).withColumnsRenamed(dict(zip(keys, by)))


def body_types(log: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """(*by, bodies, type): the type that all JSON bodies of a key have in common; what differs among them is a VARIANT."""
    parsed = log.select(*by, F.try_parse_json(F.col(body)).alias("v")).filter("v is not null")
    return parsed.groupBy(*by).agg(F.count(F.lit(1)).alias("bodies"), F.schema_of_variant_agg("v").alias("type"))


def interface_description(found: DataFrame) -> DataFrame:
    """(path, operation): each endpoint's description as JSON."""
    body = F.to_json(F.struct(F.lower("method").alias("method"), F.array("tag").alias("tags"), "calls", infer_schema(F.get("bodies", F.lit(0))).alias("schema")))
    return found.select("path", body.alias("operation"))


def looks_like_documentation(url: Column, content_type: Column, body: Column) -> Column:
    """spec, ui or other for a probed page."""
    low = F.lower(F.coalesce(body, F.lit("")))
    structured = F.lower(content_type).rlike("json|yaml") | F.lower(url).rlike(r"\.(json|ya?ml)$")
    words = low.rlike('"?(openapi|swagger)"?\\s*:')
    return F.when(structured & words, "spec").when(low.rlike("swagger-ui|redoc|rapidoc|api documentation|openapi"), "ui").otherwise("other")
