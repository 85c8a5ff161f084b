"""Scalar functions of the analytics; built-in expressions unless the value is recursive JSON."""

from __future__ import annotations

import difflib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prices in US dollars per million tokens (input, output) by part of the model's name, in order of precedence.
PRICES = (
    ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6), ("claude-3-5-sonnet", 3.0, 15.0), ("deepseek-chat", 0.27, 1.1), ("gemini-2.0-flash", 0.1, 0.4),
)
#: Prices of other models by provider; of other providers the last.
PROVIDER_PRICES = (("anthropic", 3.0, 15.0), ("gemini", 0.15, 0.6), ("vertex", 0.15, 0.6), (None, 1.0, 2.0))
#: Keys of a response's usage block, and of the numbers in it, in order of precedence.
USAGE_KEYS = ("usage", "Usage", "usageMetadata")
USAGE_NUMBERS = {
    "input_tokens": ("prompt_tokens", "input_tokens", "promptTokenCount"), "output_tokens": ("completion_tokens", "output_tokens", "candidatesTokenCount"),
    "total_tokens": ("total_tokens", "totalTokenCount"),
    "cache_read_tokens": ("cachedContentTokenCount", "cache_read_input_tokens", "prompt_tokens_details.cached_tokens"),
    "cache_write_tokens": ("cache_creation_input_tokens", "prompt_tokens_details.cache_write_tokens"), "reasoning_tokens": ("thoughtsTokenCount", "completion_tokens_details.reasoning_tokens"),
}
BLANK = r"[\x20\x09-\x0D]+"


def compact(text: Column, width: int) -> Column:
    """Whitespace collapsed; longer than ``width`` becomes width - 1 characters and an ellipsis."""
    t = F.btrim(F.regexp_replace(text, BLANK, " "))
    return F.when(F.char_length(t) > width, F.concat(F.substring(t, 1, width - 1), F.lit("…"))).otherwise(t)


def _search(value: object, key: str, accept) -> object:
    """The key's own value first, then children depth first."""
    if isinstance(value, dict):
        if key in value and (found := accept(value[key])) is not None:
            return found
        value = list(value.values())
    for child in value if isinstance(value, list) else ():
        if (found := _search(child, key, accept)) is not None:
            return found
    return None


def _number(value: object) -> float | None:
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            return None
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def _load(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(T.DoubleType())
def find_number(values: pd.Series, key: pd.Series) -> pd.Series:
    """First number (or numeric string) under a key anywhere in a JSON text."""
    return pd.Series([_search(_load(v), k, _number) for v, k in zip(values, key, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def find_string(values: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([_search(_load(v), k, lambda x: x if isinstance(x, str) else None) for v, k in zip(values, key, strict=True)], dtype=object)


#: Words that mark an error in ``kind`` or ``status``.
ERROR_WORDS = frozenset({"error", "failed", "failure", "tool.error", "llm.error"})


def has_error(value: object) -> bool:
    if isinstance(value, dict):
        for k in ("kind", "status"):
            if isinstance(value.get(k), str) and value[k].lower() in ERROR_WORDS:
                return True
        code = value.get("status_code")
        if isinstance(code, int | float) and not isinstance(code, bool) and code >= 400:
            return True
        if isinstance(value.get("error_type"), str) and value["error_type"]:
            return True
        value = list(value.values())
    return any(has_error(v) for v in value) if isinstance(value, list) else False


@F.pandas_udf(T.BooleanType())
def is_error(values: pd.Series) -> pd.Series:
    """Whether a JSON text says somewhere that something failed."""
    return values.map(lambda v: has_error(_load(v)))


def token_counts(usage: Column) -> Column:
    """prompt, completion and total from the first key present; negatives are 0, the total falls back to the sum."""
    first = lambda *keys: F.greatest(F.coalesce(*(F.get_json_object(usage, f"$.{k}").try_cast("double") for k in keys)), F.lit(0.0)).cast("long")
    prompt, completion = first("prompt_tokens", "input_tokens", "prompt_tokens_len"), first("completion_tokens", "output_tokens", "completion_tokens_len")
    total = F.coalesce(F.get_json_object(usage, "$.total_tokens").try_cast("long"), F.try_add(F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))))
    return F.struct(prompt.alias("prompt"), completion.alias("completion"), total.alias("total"))


def usage(response: Column) -> Column:
    """Token numbers of a response's JSON text, under any of the known keys; 0 for what is missing or no whole number."""
    parsed = F.try_parse_json(response)
    value = lambda path, kind: F.try_variant_get(parsed, f"$.{path}", kind)
    block, numbers = lambda path, kind: value(path, kind), {}

    def number(key: str, path: str) -> Column:
        at = f"{key}.{path}"
        whole = F.schema_of_variant(block(at, "variant")).isin("BIGINT")
        return F.when(whole & (block(at, "long") >= 0), block(at, "long"))

    def pick(key: str, name: str, paths: tuple[str, ...]) -> Column:
        if name in ("input_tokens", "output_tokens", "total_tokens"):
            return F.coalesce(*(number(key, p) for p in paths), F.lit(0))
        out = F.lit(0)  # a key that is there decides, even where its value is no number
        for p in reversed(paths):
            out = F.when(block(f"{key}.{p}", "variant").isNotNull(), F.coalesce(number(key, p), F.lit(0))).otherwise(out)
        return out

    for name, paths in USAGE_NUMBERS.items():
        out = F.lit(0)
        for key in reversed(USAGE_KEYS):
            out = F.when(value(key, "variant").isNotNull(), pick(key, name, paths)).otherwise(out)
        numbers[name] = out.cast("long")
    total = numbers["total_tokens"]
    numbers["total_tokens"] = F.when(total == 0, numbers["input_tokens"] + numbers["output_tokens"]).otherwise(total)
    return F.struct(*(c.alias(n) for n, c in numbers.items()))


def merged_usage(rows: DataFrame, response: str, by: list[str]) -> DataFrame:
    """Token numbers of the chunks of a streamed response (JSON texts, one per row), summed field by field; a chunk's ``message`` counts too."""
    both = F.array(usage(F.col(response)), usage(F.get_json_object(response, "$.message")))
    return rows.select(*by, F.explode(both).alias("u")).groupBy(*by).agg(*(F.sum(f"u.{n}").alias(n) for n in USAGE_NUMBERS))


def cost(model: Column, prompt: Column, completion: Column, provider: Column | None = None) -> Column:
    """Tokens times the price of the first table entry whose name is part of the model's, else of the provider's price."""
    paid = lambda p, c: prompt / 1e6 * p + completion / 1e6 * c
    out = paid(*PROVIDER_PRICES[-1][1:])
    for name, p, c in reversed(PROVIDER_PRICES[:-1]):
        out = out if provider is None else F.when(F.lower(provider) == name, paid(p, c)).otherwise(out)
    for name, p, c in reversed(PRICES):
        out = F.when(F.instr(F.lower(model), name) > 0, paid(p, c)).otherwise(out)
    return out


def ttft(turn: Column, metrics: Column) -> Column:
    """The turn's own time to the first token, else that of its metrics; only finite and not negative counts."""
    value = F.coalesce(turn.cast("double"), F.get_json_object(metrics, "$.ttft_ms").try_cast("double"))
    return F.when((value >= 0) & (value < math.inf) & ~F.isnan(value), value)


def latency(turn: Column, metrics: Column) -> Column:
    """The turn's own latency, else the first of the known keys; only finite and not negative counts."""
    keys = ("latency_ms", "total_latency_ms", "upstream_latency_ms", "llm_infer_ms")
    value = F.coalesce(turn.cast("double"), *(F.get_json_object(metrics, f"$.{k}").try_cast("double") for k in keys))
    return F.when((value >= 0) & (value < math.inf) & ~F.isnan(value), value)


def effective_kind(kind: Column, source: Column, calls: Column) -> Column:
    """An explicit kind, else by source: user talks, system is internal, an agent with calls acts."""
    return F.coalesce(kind, F.when(source == "user", "dialogue").when(source == "system", "internal").when((source == "agent") & (calls > 0), "autonomous").otherwise("dialogue"))


def ratio(a: str | None, b: str | None) -> float | None:
    """Similarity of whitespace-normalised texts; null if either is missing."""
    if a is None or b is None:
        return None
    return difflib.SequenceMatcher(None, " ".join(a.split()), " ".join(b.split()), autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def _fnv(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def embedding(text: str | None, dim: int) -> list[float]:
    """Counts of words by FNV-1a bucket, of length one."""
    out = np.zeros(dim)
    for word in (text or "").split():
        while word and not word[0].isalnum():
            word = word[1:]
        while word and not word[-1].isalnum():
            word = word[:-1]
        if word:
            out[_fnv(word.lower()) % dim] += 1
    size = math.sqrt(float((out * out).sum()))
    return (out / size if size else out).astype(np.float32).tolist()


def embed_text(text: Column, dim: int) -> Column:
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: embedding(t, dim))

    return embed(text)


#: What a message can hold, in order, and the keys and types that show it.
MODALITIES = ("text", "image", "audio", "tool_call")
SHOWN_BY = {"image": (("image", "image_url", "image_bytes"), ("image", "image_url")), "audio": (("audio", "input_audio"), ("audio", "input_audio"))}


def message(value: object, called: bool = False) -> tuple[str, list[str], int]:
    """Text parts joined by blanks, modalities, and length in code points of a message of any shape."""
    texts: list[str] = []
    found: set[str] = set()

    def visit(node: object) -> None:
        if isinstance(node, list):
            for child in node:
                visit(child)
        elif isinstance(node, dict):
            texts.extend(node[k] for k in ("text", "content") if isinstance(node.get(k), str) and node[k])
            for name, (keys, types) in SHOWN_BY.items():
                # false and 0 are present; null, "" and empty collections are not
                if any(node.get(k) not in (None, "", [], {}) for k in keys) or node.get("type") in types:
                    found.add(name)
            for k in sorted(node):
                if k != "text" and not (k == "content" and isinstance(node[k], str)):
                    visit(node[k])

    if isinstance(value, str):
        texts.append(value)
    else:
        visit(value)
    joined = " ".join(t for t in texts if t)
    if joined:
        found.add("text")
    if called or "<tool_call>" in joined:
        found.add("tool_call")
    return joined, [m for m in MODALITIES if m in found], len(joined)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("modalities", T.ArrayType(T.StringType())), T.StructField("char_count", T.LongType())]))
def extract_message(values: pd.Series, called: pd.Series) -> pd.DataFrame:
    """``message`` of JSON texts; what is no JSON is text itself."""
    rows = []
    for v, c in zip(values, called, strict=True):
        try:
            parsed = json.loads(v) if v is not None else None
        except ValueError:
            parsed = v
        rows.append(message(parsed, bool(c)))
    return pd.DataFrame(rows, columns=["text", "modalities", "char_count"])


#: Types of an object that is a tool call itself.
CALL_TYPES = frozenset({"tool_use", "function_call", "custom_tool_call", "local_shell_call"})


def _call(value: object) -> tuple[str | None, str, str] | None:
    """(id, name, arguments as JSON) of one call; None without a name."""
    if not isinstance(value, dict):
        return None
    inner = value["function"] if isinstance(value.get("function"), dict) else {}
    name = inner.get("name", value.get("name"))
    if not isinstance(name, str):
        return None
    key = value.get("id", value.get("call_id"))
    given = next((d[k] for d, k in ((inner, "arguments"), (value, "arguments"), (value, "input")) if k in d), {})
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            pass
    return key if isinstance(key, str) else None, name, json.dumps(given, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def tool_calls(value: object) -> list[tuple[str | None, str, str]]:
    """The calls anywhere in a request or response, each once, in order of first appearance."""
    found: dict[tuple, None] = {}

    def visit(node: object) -> None:
        if isinstance(node, list):
            for child in node:
                visit(child)
        elif isinstance(node, dict):
            listed = node.get("tool_calls")
            own = [node] if node.get("type") in CALL_TYPES else []
            for c in [*(listed if isinstance(listed, list) else []), *own]:
                if (call := _call(c)) is not None:
                    found.setdefault(call)
            for k in sorted(node):
                if k != "tool_calls":
                    visit(node[k])

    visit(value)
    return list(found)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("arguments_json", T.StringType())])))
def wire_tool_calls(values: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("id", "name", "arguments_json"), c, strict=True)) for c in tool_calls(_load(v))] for v in values], dtype=object)
