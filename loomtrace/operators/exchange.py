"""Exports and side tables: HAR, spans, turns by request, revisions, offloaded content, schema views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .projection import REQUEST, RESPONSE, call_pairs
from .tables import upsert

PREVIEW_CHARS = 256
#: Bytes from which a cell is moved to the objects table.
OFFLOAD_BYTES = 64 * 1024


def _wire(record: str) -> Column:
    """What went over the wire: the payload's ``http``, or the payload itself."""
    payload = F.col(f"{record}.payload")
    return F.coalesce(F.get_json_object(payload, "$.http"), payload)


def _text_at(wire: Column, *keys: str) -> Column:
    """The first of the keys that is there, as text; other kinds of values are the empty text."""
    parsed = F.try_parse_json(wire)
    held = [F.try_variant_get(parsed, f"$.{k}", "variant") for k in keys]
    out = F.lit("")
    for k, v in reversed(list(zip(keys, held, strict=True))):
        out = F.when(v.isNotNull(), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(parsed, f"$.{k}", "string")).otherwise("")).otherwise(out)
    return out


def _headers(wire: Column) -> Column:
    """Names and values in order of name; values that are no text are redacted."""
    held = F.from_json(F.get_json_object(wire, "$.headers"), "map<string, variant>")
    rows = F.transform(F.array_sort(F.map_entries(F.transform_values(held, lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise("<redacted>")))), lambda e: F.struct(e.key.alias("name"), e.value.alias("value")))
    return F.coalesce(rows, F.array().cast("array<struct<name string, value string>>"))


def _body(wire: Column) -> Column:
    """The first body there is: text as it is, else its JSON."""
    return F.coalesce(*(F.get_json_object(wire, f"$.{k}") for k in ("body", "request_body", "response_body")), F.lit(""))


def har_entries(events: DataFrame) -> DataFrame:
    """One row per call with a request: session_id, call_id and the HAR fields of both sides."""
    asked, answered = _wire("request"), _wire("response")
    number = lambda w, k, kind: F.when(F.col("response").isNotNull(), F.try_variant_get(F.try_parse_json(w), f"$.{k}", kind))
    status = number(answered, "status", "long")
    return call_pairs(events).select(
        "session_id", "call_id", F.col("request.timestamp").alias("started"), F.coalesce(number(answered, "duration_ms", "double"), F.lit(0.0)).alias("time"),
        _text_at(asked, "method").alias("method"), _text_at(asked, "url", "path").alias("url"), _text_at(asked, "version").alias("version"), _headers(asked).alias("request_headers"), _body(asked).alias("request_body"),
        F.when(status >= 0, status).otherwise(F.lit(0)).alias("status"), F.when(F.col("response").isNotNull(), _text_at(answered, "version")).otherwise("").alias("response_version"),
        _headers(answered).alias("response_headers"), F.when(F.col("response").isNotNull(), _body(answered)).otherwise("").alias("response_body"), F.col("request.trace_id").alias("trace_id"),
        F.coalesce(F.try_variant_get(F.try_parse_json(F.col("request.payload")), "$.degraded", "boolean"), F.lit(False)).alias("degraded"),
    )


def har(events: DataFrame) -> DataFrame:
    """One row per session with its entries in order of call id."""
    rows = har_entries(events)
    return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "session_id"]))).alias("entries"))


def har_json(events: DataFrame, creator: str = "loomtrace", version: str = "1") -> DataFrame:
    """The HAR 1.2 text of each session; what HAR has no place for stands under ``_`` and the creator's name."""
    size, mime = F.lit(-1), F.lit("application/json").alias("mimeType")

    def entry(e: Column) -> Column:
        request = F.struct(
            e.method.alias("method"), e.url.alias("url"), e.version.alias("httpVersion"), e.request_headers.alias("headers"), F.array().cast("array<string>").alias("queryString"),
            F.struct(mime, e.request_body.alias("text")).alias("postData"), size.alias("headersSize"), size.alias("bodySize"),
        )
        response = F.struct(
            e.status.alias("status"), F.lit("").alias("statusText"), e.response_version.alias("httpVersion"), e.response_headers.alias("headers"), F.struct(size.alias("size"), mime, e.response_body.alias("text")).alias("content"),
            F.lit("").alias("redirectURL"), size.alias("headersSize"), size.alias("bodySize"),
        )
        timings = F.struct(size.alias("send"), size.alias("wait"), size.alias("receive"))
        own = F.struct(e.call_id.alias("call_id"), e.trace_id.alias("trace_id"), e.degraded.alias("degraded")).alias(f"_{creator}")
        started = F.date_format(e.started, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startedDateTime")
        return F.struct(started, e.time.alias("time"), request.alias("request"), response.alias("response"), F.create_map().cast("map<string,string>").alias("cache"), timings.alias("timings"), own)

    made = F.struct(F.lit(creator).alias("name"), F.lit(version).alias("version"))
    log = F.struct(F.lit("1.2").alias("version"), made.alias("creator"), F.transform("entries", entry).alias("entries"))
    return har(events).select("session_id", F.to_json(F.struct(log.alias("log"))).alias("har"))


def spans(events: DataFrame, prefix: str = "loomtrace") -> DataFrame:
    """One span per event, named by its kind, with the record's identity and payload as attributes."""
    attribute = lambda key, value, kind="stringValue": F.struct(
        F.lit(f"{prefix}.{key}").alias("key"), F.struct(*((value if k == kind else F.lit(None).cast("string")).alias(k) for k in ("stringValue", "intValue"))).alias("value")
    )
    attributes = F.array(
        attribute("session_id", F.col("session_id")), attribute("event_id", F.col("event_id")), attribute("seq", F.col("seq").cast("string"), "intValue"),
        attribute("payload", F.get_json_object("payload_json", "$.payload")),
    )
    return events.select("append_pos", "session_id", F.col("kind").alias("name"), F.col("trace_id").alias("trace"), F.col("call_id").alias("span"), (F.unix_micros("timestamp") * 1000).alias("start_ns"), attributes.alias("attributes"))


def spans_json(events: DataFrame, service: str = "loomtrace") -> DataFrame:
    """The OTLP JSON text of each session."""
    span = F.struct(
        F.col("append_pos").alias("at"), F.struct(F.col("trace").alias("traceId"), F.col("span").alias("spanId"), "name", F.coalesce("start_ns", F.lit(0)).cast("string").alias("startTimeUnixNano"),
                                                F.coalesce("start_ns", F.lit(0)).cast("string").alias("endTimeUnixNano"), "attributes").alias("span"))
    grouped = spans(events, service).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x.span).alias("spans"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.create_map(F.lit("stringValue"), F.lit(service)).alias("value"))).alias("attributes"))
    scope = F.struct(F.struct(F.lit(service).alias("name")).alias("scope"), "spans")
    return grouped.select("session_id", F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("otlp"))


_SPAN = "struct<name string, traceId string, trace_id string, spanId string, span_id string, attributes array<struct<key string, value map<string, string>>>>"


def spans_from_json(texts: DataFrame, column: str = "value", prefix: str = "loomtrace") -> DataFrame:
    """Events (the columns of EVENTS) from OTLP JSON: every span becomes one, marked degraded and not to be replayed.

    Their numbers follow the spans' places in the text; the session comes from the span's attributes.
    """
    scopes = f"array<struct<spans array<{_SPAN}>>>"
    found = F.from_json(column, f"resourceSpans array<struct<scopeSpans {scopes}, scope_spans {scopes}>>").resourceSpans
    each = F.flatten(F.flatten(F.transform(found, lambda r: F.transform(F.coalesce(r.scopeSpans, r.scope_spans), lambda s: F.coalesce(s.spans, F.array().cast(f"array<{_SPAN}>"))))))
    rows = texts.select(F.posexplode(each).alias("seq", "s"))
    attributes = F.map_from_entries(F.transform(F.coalesce("s.attributes", F.array().cast("array<struct<key string, value map<string, string>>>")), lambda a: F.struct(a.key, F.try_element_at(F.map_values(a.value), F.lit(1)))))
    payload = F.struct(F.struct(F.lit(True).alias("degraded"), F.lit(False).alias("replayable"), F.struct(F.col("s.name").alias("name"), F.col("attributes")).alias("otel")).alias("payload"))
    rows = rows.withColumn("attributes", attributes)
    return rows.select(
        F.col("seq").cast("long").alias("seq"), F.lit("otel.span").alias("kind"), F.lit("otel").alias("source"), F.try_element_at("attributes", F.lit(f"{prefix}.session_id")).alias("session_id"),
        F.coalesce("s.traceId", "s.trace_id").alias("trace_id"), F.coalesce("s.spanId", "s.span_id").alias("call_id"), F.to_json(payload).alias("payload_json"),
    )


def turns(events: DataFrame) -> DataFrame:
    """Events grouped by the request before them; what comes before the first request is turn 0."""
    number = F.count(F.when(F.col("kind").isin(*REQUEST), 1)).over(Window.partitionBy("session_id").orderBy("append_pos"))
    return events.withColumn("turn", number).groupBy("session_id", "turn").agg(
        F.count("*").alias("events"), F.min("append_pos").alias("opened"), F.max("append_pos").alias("last"), F.count(F.when(F.col("kind").isin(*RESPONSE), 1)).alias("responses")
    )


def upsert_revisions(rows: DataFrame, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Revisions with changes applied by id, in order of creation."""
    return upsert(rows, changes, ["revision_id"]).orderBy(*(order or ["created_at", "revision_id"]))


def offload(rows: DataFrame, column: str, least: int = OFFLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows whose large cells are replaced by content ids, and the objects table of these cells, each content once."""
    large = F.octet_length(column) >= least
    tagged = rows.withColumn("content_id", F.when(large, F.sha2(F.col(column).cast("binary"), 256)))
    objects = tagged.where(large).select("content_id", F.col(column).alias("payload")).dropDuplicates(["content_id"])
    return tagged.withColumn(column, F.when(~large, F.col(column))), objects


def hydrate(rows: DataFrame, objects: DataFrame, column: str) -> DataFrame:
    """Cells back in place; pruned with the join where the column is not selected."""
    return rows.join(objects, "content_id", "left").withColumn(column, F.coalesce(column, "payload")).drop("content_id", "payload")


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def information_schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, ordinal_position, data_type of the given tables, from their schemas only."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string")
