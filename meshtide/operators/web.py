"""Fields from stored pages and payloads."""

from __future__ import annotations

import contextlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Patterns of addresses and request fields in page sources, with the group that counts.
STRINGS = (
    (r"""(?i)https?://[^"'\s)]+""", 0),
    (r"""(?i)["'](/[^"']*(?:api|observ|water|suii|river|kawabou|telemetry)[^"']*)["']""", 1),
    (r"""(?i)["']([^"']*(?:obsCd|obsrvId|ofcCd|itmkndCd)[^"']*)["']""", 1),
)
# Where a charset is stated, most trusted first, how far into a page it counts, and what is tried after that.
CHARSET_SOURCES = (
    ("header", r"(?i)charset=([A-Za-z0-9._-]+)"),
    ("body", r"""(?i)charset\s*=\s*["']?([A-Za-z0-9._-]+)"""),
)
STATED_WITHIN = 4096
ENCODINGS = ("utf-8", "cp932", "shift_jis", "euc_jp")


ATTRIBUTES = r"""((?:[^>"']|"[^"]*"|'[^']*')*)"""
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


#: References that count without their semicolon too, unless an attribute's value goes on behind them.
BARE = ("&quot;", "&lt;", "&gt;", "&amp;")


def _unescaped(text: Column, in_attribute: bool = False) -> Column:
    for name, sign in ENTITIES:
        if name in BARE:
            text = F.regexp_replace(text, f"{name}|{name[:-1]}" + ("(?![=A-Za-z0-9])" if in_attribute else ""), sign)
        else:
            text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def visible_markup(html: Column) -> Column:
    """A page without its comments and without what stands inside scripts and styles; null counts as empty."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?(?:-->|\z)", "")
    return F.regexp_replace(html, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>|\z)", "$1$3")


def attribute_values(markup: Column, tag: str, attribute: str) -> Column:
    """The non-empty values of an attribute of all elements with a tag, in page order, quoted or not."""
    lists = F.regexp_extract_all(markup, F.lit(rf"(?is)<{tag}(?=[\s/>]){ATTRIBUTES}>"), F.lit(1))
    value = rf"""(?is)(?:^|[\s"'/]){attribute}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    of = lambda a: _unescaped(F.concat(*[F.regexp_extract(a, value, k) for k in (1, 2, 3)]), in_attribute=True)
    return F.filter(F.transform(lists, of), lambda v: v != "")


def element_text(markup: Column, tag: str) -> Column:
    """The trimmed text of the first element with a tag; empty if there is none."""
    inner = F.regexp_extract(markup, rf"(?is)<{tag}(?=[\s/>]){ATTRIBUTES}>(.*?)</{tag}", 2)
    return _unescaped(F.regexp_replace(F.regexp_replace(inner, "(?s)<[^>]*>", ""), r"^\s+|\s+$", ""))


@F.arrow_udf(ArrayType(StringType()))
def resolved(base: pa.Array, refs: pa.Array) -> pa.Array:
    """References made absolute against a page's address; what cannot be resolved stays as it is."""
    return pa.array([r if r is None else [_joined(b or "", x) for x in r] for b, r in zip(base.to_pylist(), refs.to_pylist(), strict=True)], pa.list_(pa.string()))


def html_resources(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wanted: dict[str, tuple[str, str]] | None = None, text_of: str = "title") -> DataFrame:
    """``id, title`` and a list of resolved references for each of ``wanted`` (column name to tag and attribute; scripts and links if not given).

    Only the references go through Python, to be resolved against the page's url;
    null html has an empty title and no references.
    """
    wanted = wanted or {"scripts": ("script", "src"), "links": ("a", "href")}
    m = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"), visible_markup(F.col(html_col)).alias("_markup"))
    found = m.select("id", "_url", element_text(F.col("_markup"), text_of).alias(text_of), *[attribute_values(F.col("_markup"), *where).alias(name) for name, where in wanted.items()])
    return found.select("id", text_of, *[resolved("_url", name).alias(name) for name in wanted])


def _joined(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


def allowed_urls(urls: Column, hosts: list[str]) -> Column:
    """https addresses of allowed hosts, the first of each kept in order."""
    fine = F.filter(urls, lambda u: u.startswith("https://") & F.regexp_extract(u, r"^https://([^/?#:]*)", 1).isin(hosts))
    return F.array_distinct(fine)


def candidate_strings(text: Column, most: int = 500) -> Column:
    """Sorted distinct matches of STRINGS of 3 to 600 characters; ``most`` is the report's length."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in STRINGS])
    return F.slice(F.sort_array(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda s: (F.length(s) >= 3) & (F.length(s) <= 600)))), 1, most)


def _first_fitting(raw: bytes, names: list[str]) -> tuple[str, str] | None:
    """The first of ``names`` that Python knows and that decodes ``raw``, with the text."""
    for name in names:
        with contextlib.suppress(LookupError, UnicodeDecodeError):
            return name, raw.decode(name)
    return None


def decoded(df: DataFrame, body: str, content_type: str) -> DataFrame:
    """Adds ``text`` and ``encoding`` of binary ``body``.

    The charsets that CHARSET_SOURCES find come first, then ENCODINGS; what fits
    none is read as UTF-8 with replacement characters (``utf-8-replace``). Null
    bodies stay null. Which names to try is worked out in the JVM; Python only decodes.
    """
    start = F.regexp_replace(F.decode(F.substring(F.col("_raw"), 1, STATED_WITHIN), "ISO-8859-1"), r"[^\x00-\x7F]", "")
    seen = {"header": F.col(content_type).cast("string"), "body": start}
    stated = [F.nullif(F.regexp_extract(F.coalesce(seen[place], F.lit("")), pattern, 1), F.lit("")) for place, pattern in CHARSET_SOURCES]
    names = F.array_compact(F.array(*stated, *[F.lit(e) for e in ENCODINGS]))

    @F.arrow_udf("text string, encoding string")
    def run(bodies: pa.Array, tries: pa.Array) -> pa.Array:
        texts, used = [], []
        for raw, candidates in zip(bodies.to_pylist(), tries.to_pylist(), strict=True):
            found = (None, None) if raw is None else _first_fitting(raw, candidates) or ("utf-8-replace", raw.decode("utf-8", "replace"))
            used.append(found[0])
            texts.append(found[1])
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(used, pa.string())], ["text", "encoding"])

    d = df.withColumn("_raw", F.col(body).cast("binary")).withColumn("_found", run(F.col("_raw"), names))
    return d.withColumn("text", F.col("_found.text")).withColumn("encoding", F.col("_found.encoding")).drop("_raw", "_found")


def distinct_in_order(df: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """First occurrence of each value in a group; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(position).alias(position))


def first_values(df: DataFrame, group: str, value: str, position: str, most: int) -> DataFrame:
    """``group, values``: for each group the first ``most`` distinct values in order of their first occurrence; groups of nulls alone are left out."""
    d = distinct_in_order(df, group, value, position)
    d = d.withColumn("_ix", F.row_number().over(W.partitionBy(group).orderBy(position, value))).where(F.col("_ix") <= most)
    return d.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_ix", value))), lambda x: x[value]).alias("values"))


def reach_report(fetches: DataFrame, required: DataFrame) -> DataFrame:
    """One row ``status, unreachable, stations, reached, candidates`` for ``fetches(station, status, candidates array<string>)``.

    ``unreachable`` lists, sorted, the ``required(station)`` that no fetch with status 200
    reached; ``status`` is ``passed`` if there are none, else ``partial``. ``candidates``
    counts the distinct candidate strings of all fetches, which :func:`found_candidates` lists.
    """
    r = reachability(fetches, required).agg(F.sort_array(F.collect_list(F.when(F.col("missing"), F.col("station")))).alias("unreachable"), F.count_if(F.col("tries") > 0).alias("stations"), F.count_if(F.col("ok") > 0).alias("reached"))
    n = found_candidates(fetches).agg(F.count(F.lit(1)).alias("candidates"))
    return r.join(F.broadcast(n)).select(F.when(F.size("unreachable") == 0, "passed").otherwise("partial").alias("status"), "unreachable", "stations", "reached", "candidates")


def found_candidates(fetches: DataFrame) -> DataFrame:
    """``candidate, fetches``: the distinct strings of ``fetches(candidates array<string>)`` and how many fetches hold each."""
    each = fetches.select(F.explode(F.array_distinct("candidates")).alias("candidate")).where("candidate is not null")
    return each.groupBy("candidate").agg(F.count(F.lit(1)).alias("fetches"))


def reachability(fetches: DataFrame, required: DataFrame) -> DataFrame:
    """``station, tries, ok, missing``: tries, those with status 200, and whether a required station was never reached."""
    r = fetches.groupBy("station").agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.col("status") == 200).alias("ok"))
    j = required.select("station").distinct().withColumn("wanted", F.lit(True)).join(r, "station", "full_outer")
    ok = F.coalesce("ok", F.lit(0))
    return j.select("station", F.coalesce("tries", F.lit(0)).alias("tries"), ok.alias("ok"), (F.coalesce("wanted", F.lit(False)) & (ok == 0)).alias("missing"))


def flattened(df: DataFrame, id_col: str, json_col: str, levels: int = 1000) -> DataFrame:
    """``id, path, value``: the scalars of JSON texts with their paths, at any depth.

    A recursive query unfolds one level of all rows at a time; the texts are read
    and parsed once. Texts that are not JSON, and empty objects and arrays, give no
    row; JSON null gives the text ``null``. A text nested deeper than ``levels`` fails the job; nothing is cut.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # as many rows as there are scalars
    rows = df.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    return spark.sql(f"""
        WITH RECURSIVE found(id, path, v) MAX RECURSION LEVEL {int(levels)} AS (
          SELECT id, '$', v FROM {{rows}}
          UNION ALL
          SELECT f.id, CASE WHEN e.key IS NULL THEN concat(f.path, '[', e.pos, ']') ELSE concat(f.path, '.', e.key) END, e.value FROM found f, LATERAL variant_explode(f.v) e)
        SELECT id, path, coalesce(try_variant_get(v, '$', 'string'), to_json(v)) AS value FROM found
        WHERE NOT (startswith(schema_of_variant(v), 'OBJECT') OR startswith(schema_of_variant(v), 'ARRAY'))""", rows=rows)
