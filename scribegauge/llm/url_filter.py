"""URL filters with redirect equivalence (DataFrame functions only).

A URL is judged by the longest rule that fits it.  A URL without a rule of its
own takes the decision of its equivalence class: URLs joined by redirect or
canonical-link edges form a connected component, and a component with a
blocked member is blocked.  An explicit rule, above all an explicit allow,
always takes precedence over what the class would propagate.

Defined results: a null or scheme-less url has empty host and path, no rule
and verdict ``allow`` unless a rule with an empty host is given; repeated rows
are judged alike, one output row per input row; an empty table gives an empty
result; columns ``host, path, rule, verdict`` of the input are replaced, other
columns pass through untouched, and working columns have reserved names that
start with ``_uf_``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .runtime import checkpointed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


@dataclass(frozen=True)
class UrlRule:
    """``text`` is host and path prefix, such as ``example.org/es/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        host, slash, rest = self.text.partition("/")
        return slash + rest


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://" + pattern, 1)


def url_host(url: Column) -> Column:
    return F.translate(_part(url, "([^/?#]*)"), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return _part(url, "[^/?#]*([^?#]*)")


def without_dots(path: Column) -> Column:
    """The path without its ``.`` and ``..`` segments, as browsers ask for it."""

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    parts = F.aggregate(F.split(ended, "/"), F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.array_join(parts, "/")).otherwise(path)


def url_key(url: Column) -> Column:
    """Identity of a URL for equivalence: host, path without dot segments, and query; no scheme or fragment."""
    return F.nullif(F.concat(url_host(url), without_dots(url_path(url)), _part(url, "[^?#]*([^#]*)")), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Struct ``(rule, verdict)`` of the longest fitting rule, or null."""
    longest_first = sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)
    at = None
    for i, rule in enumerate(longest_first):
        fits = (host == rule.host) | host.endswith("." + rule.host)
        fits = fits & path.startswith(rule.path) if rule.path else fits
        at = F.when(fits, F.lit(i)) if at is None else at.when(fits, F.lit(i))
    if at is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.array(*(F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in longest_first))
    return F.get(known, at)


#: What holds no elements of the page, even if its text looks like some; unclosed, it reaches to the end.
PASSIVE = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{tag}\\b[^>]*>.*?(?:</{tag}\\b|\\z)" for tag in ("script", "style", "textarea", "title"))


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(src, dst)`` of URL keys from canonical links and refresh redirects.

    Comments, scripts, styles, text areas and titles hold no elements.
    """
    raw = F.coalesce(F.col(html_col), F.lit(""))
    html = F.regexp_replace(raw, PASSIVE, "")
    canonical = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    marked = raw.rlike(r"(?i)\bcanonical\b|\brefresh\b")
    found = pages.where(marked).select(
        F.col(url_col).alias("_uf_url"),
        F.explode(F.array(canonical, refresh)).alias("_uf_to"),
    ).where("_uf_to != ''")
    own, to = F.col("_uf_url"), F.regexp_replace("_uf_to", "(?i)&(amp|#38|#x26);", "&")
    host, folder = url_host(own), F.regexp_replace(url_path(own), "[^/]*$", "")
    absolute = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(F.lit("http://"), host, to))
        .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), to))
    )
    return found.select(url_key(own).alias("src"), url_key(absolute).alias("dst")).where(
        "src is not null and dst is not null and src != dst"
    )


def blocked_aliases(edges: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """Keys of every node whose component holds a URL blocked by a rule of its own."""
    labels = connected_components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    own = match_rule(url_host(as_url), url_path(as_url), rules)
    judged = labels.select("node", "label", (F.coalesce(own["verdict"], F.lit("")) == "block").alias("_uf_hit"))
    bad = judged.where("_uf_hit").select("label").distinct()
    return judged.join(bad, "label", "left_semi").select(F.col("node").alias("_uf_key"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    edges: DataFrame | None = None,
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` is a stated list, compiled into one expression, so judging by
    rule is a scan without a shuffle.  ``edges`` has columns ``src`` and
    ``dst`` of :func:`url_key` values.  Only their components are computed,
    and only when there are any; the join back to the pages is on the key.
    """
    url = F.col(url_col)
    out = pages.withColumns({"host": url_host(url), "path": url_path(url)})
    out = out.withColumn("_uf_own", match_rule(F.col("host"), F.col("path"), rules))
    inherited = F.lit(False)
    if edges is not None:
        edges = checkpointed(edges.distinct())
        if not edges.isEmpty():
            bad = blocked_aliases(edges, rules).withColumn("_uf_bad", F.lit(True))
            out = out.withColumn("_uf_key", url_key(url)).join(bad, "_uf_key", "left")
            inherited = F.coalesce(F.col("_uf_bad"), F.lit(False))
    verdict = F.coalesce(F.col("_uf_own")["verdict"], F.when(inherited, "block").otherwise(F.lit(default)))
    out = out.withColumns({"rule": F.col("_uf_own")["rule"], "verdict": verdict})
    return reduce(lambda d, c: d.drop(c), ("_uf_own", "_uf_key", "_uf_bad"), out)
