"""URL rules with redirect equivalence.

Rules (verdict, host, path) fit a host and all its subdomains where the url's
path starts with the rule's; the longest fitting rule decides.  Urls that name
the same resource (redirects, canonical links, meta refreshes) are edges of a
graph; its connected components are the classes of aliases.  A page without a
rule of its own takes its class's decision: block if a member is blocked by
rule and none is allowed by rule, else allow.  A page's own rule always
stands, so an explicit allow is never overruled by an alias.

Rules are few (a parameter); beyond ``MAX_RULES`` they are joined on host
suffixes instead of being tried one by one.

Edge cases: a null url, or one without ``://``, has empty host and path, no
rule and no aliases, so it is allowed; of equally long rules the one with the
longer host, then the smaller text decides; repeated rows get equal verdicts;
chains and cycles of redirects are one class; html and urls of any length are
read whole, where a tag ends at its first ``>``; character references in a
link that name no character stay as they are; an empty table gives an empty
result; of further columns those named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.components import connected_components
from starloom.llm.skew import split_left_join
from starloom.llm.store import stored

MAX_RULES = 200

_ATTR = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: named character references that links are written with
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_REFERENCE = r"(?s)^(amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});(.*)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Host as the rules see it (A-Z lower-cased; empty if there is none)."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]], max_rules: int = MAX_RULES) -> DataFrame:
    """``urls`` (with host and path) plus ``rule`` and ``ruled`` (the rule's
    text and verdict, or null)."""
    ranked = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    if len(ranked) <= max_rules:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for kind, host, path in reversed(ranked):
            own = (F.col("host") == host) | F.col("host").endswith("." + host)
            fits = own & F.col("path").startswith(path)
            rule = F.when(fits, F.lit(host + path)).otherwise(rule)
            verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
        return urls.withColumns({"rule": rule, "ruled": verdict})
    # Many rules: every distinct (host, path) meets only the rules of its own
    # host suffixes.  Salting spreads a suffix like "com" over the cluster.
    spark, salts = urls.sparkSession, 32
    table = spark.createDataFrame(
        [(i, v, h, p) for i, (v, h, p) in enumerate(ranked)], "place long, verdict string, rule_host string, rule_path string"
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    spread = names.withColumns(
        {"rule_host": F.explode(suffixes), "salt": F.pmod(F.hash("host", "path"), F.lit(salts))}
    )
    fit = spread.join(table, ["rule_host", "salt"]).where(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy("host", "path").agg(
        F.min(F.struct("place", F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best")
    )
    return (
        urls.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.verdict")})
        .select(*[c for c in urls.columns if c not in ("rule", "ruled")], "rule", "ruled")
    )


def decoded(text: Column) -> Column:
    """``text`` with its character references decoded."""

    def one(piece: Column) -> Column:
        """What follows an ``&``: the character a reference names, then the rest."""
        name = F.regexp_extract(piece, _REFERENCE, 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
        code = F.when(name.startswith("#"), code.cast("int"))
        fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        other = F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code)), 8, "0")), "UTF-32")
        for known, letter in _NAMED.items():
            other = F.when(name == known, F.lit(letter)).otherwise(other)
        tail = F.regexp_extract(piece, _REFERENCE, 2)
        return F.coalesce(F.concat(F.when(name != "", other), tail), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    return F.when(text.contains("&"), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    found = rf"(?is)\s{name}\s*=\s*{_ATTR}"
    return decoded(F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)]))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    last = F.element_at(parts, -1)
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(F.lit("/"), F.array_join(kept, "/"), end)
    return F.when(path.startswith("/") & path.contains("/."), plain).otherwise(path)


def normal_url(url: Column) -> Column:
    """A url as a node of the alias graph: scheme and host lower-cased, dot
    segments resolved, and the fragment, which never reaches a server, cut off."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    path = without_dots(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), url_host(url), F.when(path == "", "/").otherwise(path), query)


def absolute(base: Column, link: Column) -> Column:
    """``link`` resolved against the absolute url ``base``; dot segments are
    left to :func:`normal_url`."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    whole = F.regexp_extract(base, r"(?s)^([^#]*)", 1)
    folder = F.concat(origin, F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1))
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(whole, link))
        .otherwise(F.concat(folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) from canonical links and meta refreshes in html."""
    tags = F.regexp_extract_all(
        F.col("html"), F.lit(r"(?is)<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>"), F.lit(0)
    )
    # Few pages carry such tags; each step is stored, since the next one uses
    # its columns many times.
    found = pages.where(F.col("url").contains("://")).select("url", F.explode(tags).alias("tag"))
    found = stored(found, "url-tags")
    is_link = F.lower(F.col("tag")).startswith("<link")
    kinds = F.split(F.lower(_attribute(F.col("tag"), "rel")), r"[ \t\n\f\r]+")
    canonical = F.when(is_link & F.array_contains(kinds, "canonical"), _attribute(F.col("tag"), "href"))
    refresh = F.when(
        ~is_link & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"),
        F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1),
    )
    links = stored(found.select("url", F.trim(F.coalesce(canonical, refresh)).alias("link")), "url-links")
    links = links.where(F.length("link") > 0).select("url", absolute(F.col("url"), F.col("link")).alias("target"))
    links = stored(links, "url-targets")
    return links.select(normal_url(F.col("url")).alias("src"), normal_url(F.col("target")).alias("dst"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    redirects: DataFrame | None = None,
    url_col: str = "url",
) -> DataFrame:
    """``pages`` plus host, path, rule and verdict.

    ``redirects``: optional further edges (src, dst) of absolute urls, as a
    crawl logs them.  Links in a column ``html``, if there is one, are used."""
    spark: SparkSession = pages.sparkSession
    named = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    judged = with_rules(named, rules)
    edges = spark.createDataFrame([], "src string, dst string")
    if "html" in pages.columns:
        edges = edges.union(page_links(pages.select(F.col(url_col).alias("url"), "html")))
    if redirects is not None:
        edges = edges.union(redirects.select(normal_url(F.col("src")), normal_url(F.col("dst"))))
    edges = stored(edges, "url-edges")
    classes = connected_components(edges)  # (node, component)
    node = F.when(F.col(url_col).contains("://"), normal_url(F.col(url_col)))
    # Rules judge every node of a class, also targets that were never crawled.
    nodes = classes.withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))})
    verdicts = (
        with_rules(nodes, rules)
        .groupBy("component")
        .agg(
            F.max((F.col("ruled") == "allow").cast("int")).alias("allowed"),
            F.max((F.col("ruled") == "block").cast("int")).alias("blocked"),
        )
        .where((F.col("blocked") == 1) & (F.coalesce("allowed", F.lit(0)) == 0))
    )
    condemned = classes.join(verdicts.select("component"), "component", "left_semi").select(
        F.col("node").alias("_node"), F.lit(True).alias("_condemned")
    )
    return (
        split_left_join(judged.withColumn("_node", node), stored(condemned, "url-condemned"), "_node")
        .withColumn(
            "verdict", F.coalesce("ruled", F.when(F.col("_condemned"), F.lit("block")).otherwise(F.lit("allow")))
        )
        .drop("_node", "_condemned", "ruled")
    )
