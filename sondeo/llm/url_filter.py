"""Verdicts on URLs: fixed rules first, else a tree of path templates for each host.

The path's segments become tokens: a literal that is frequent enough at its place on its
host, else its shape (runs of digits as ``#``) if that is, else ``*``.  The tokens of a host
form a tree; level by level, siblings merge whose branches look alike (next tokens) and whose
labels don't differ significantly.  A template's purity is the share of good labels among its
pages, smoothed with its parent's, and a template below the least purity is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Segments of a path that are tokens of their own; what lies deeper is one token, ``**``.
LEVELS = 6
#: A literal or shape is a token if it has so many rows, and this part of its place's rows.
SUPPORT, SHARE = 4, 0.01
#: Longer segments are no literals.
LONGEST = 64
#: Siblings merge up to this distance of their next tokens, and this z-score of their labels.
APART, Z = 0.3, 1.96
#: Weight of the parent's purity, in labelled rows; templates below the least purity are blocked.
PRIOR, LEAST_PURITY = 10.0, 0.5
#: A key with more than one in HOT rows joins by broadcast: there are at most HOT such keys.
HOT = 500


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower
    case, and from there up to ``?``, ``#`` or the end; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), AZ, AZ.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, else null.  A rule
    ``(verdict, "host/path")`` fits its host and all subdomains of it where the path begins
    with the rule's; of equally long ones the longer host, then ``block`` goes first."""
    cut = lambda r: (r.split("/", 1)[0], r[len(r.split("/", 1)[0]) :])
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), len(cut(r[1])[0]), r[0] == "block")):
        own, begin = cut(rule)
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(begin))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "#")


def joined(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``small``, whose ``weight`` is the number of rows of each
    key.  Keys with more than one in HOT of all ``total`` rows, of which there can be no more
    than HOT, are broadcast, so no task meets all rows of a frequent key; the others are shuffled."""
    hot = F.col(weight) * HOT > total
    often, rare = small.filter(hot).drop(weight), small.filter(~hot).drop(weight)
    first = rows.join(F.broadcast(often), keys)
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rare, keys, "left")
    return first.unionByName(rest)


def vocabularies(rows: DataFrame) -> DataFrame:
    """``(host, vocabulary, rows)``: of each host the literals and shapes that are tokens, as
    ``level/l.literal`` and ``level/s.shape``: 1 / SHARE of each at most for each level, and
    its number of rows."""
    places = rows.select("host", F.posexplode(F.slice("segments", 1, LEVELS)).alias("level", "segment"))
    sizes = places.groupBy("host", "level").agg(F.count("*").alias("all"))
    kinds = F.array(F.when(F.length("segment") <= LONGEST, F.concat(F.lit("l."), "segment")), F.when(F.length(shape(F.col("segment"))) <= LONGEST, F.concat(F.lit("s."), shape(F.col("segment")))))
    often = places.select("host", "level", F.explode(F.array_compact(kinds)).alias("token")).groupBy("host", "level", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
    rank = F.row_number().over(Window.partitionBy("host", "level", F.substring("token", 1, 1)).orderBy(F.desc("n"), "token"))
    top = often.withColumn("rank", rank).filter(F.col("rank") <= int(1 / SHARE)).drop("rank")
    top = top.join(sizes, ["host", "level"]).filter(F.col("n") >= F.col("all") * SHARE)
    tokens = top.groupBy("host").agg(F.sort_array(F.collect_set(F.concat(F.col("level").cast("string"), F.lit("/"), "token"))).alias("vocabulary"))
    return rows.groupBy("host").agg(F.count("*").alias("rows")).join(tokens, "host", "left")


def template_tokens(segments: Column, vocabulary: Column) -> Column:
    known = lambda kind, s, i: F.coalesce(F.array_contains(vocabulary, F.concat(i.cast("string"), F.lit(f"/{kind}."), s)), F.lit(False))
    token = lambda s, i: F.when(known("l", s, i), s).when(known("s", shape(s), i), shape(s)).otherwise("*")
    deep = F.when(F.size(segments) > LEVELS, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.slice(segments, 1, LEVELS), token), deep)


def _alike(a: Column, b: Column) -> Column:
    """Whether two branches have similar next tokens and labels that may come from one share."""
    both = a["lab"] + b["lab"]
    pooled = (a["bad"] + b["bad"]) / both
    z = F.abs(a["bad"] / a["lab"] - b["bad"] / b["lab"]) / F.sqrt(pooled * (1 - pooled) * (1 / a["lab"] + 1 / b["lab"]))
    same = F.when((a["lab"] == 0) | (b["lab"] == 0) | (pooled == 0) | (pooled == 1), True).otherwise(z < Z)
    share = lambda x, t: F.coalesce(F.try_element_at(x["next"], t), F.lit(0)) / x["n"]
    far = F.aggregate(F.array_union(F.map_keys(a["next"]), F.map_keys(b["next"])), F.lit(0.0), lambda s, t: s + F.abs(share(a, t) - share(b, t))) / 2
    return same & (far <= APART)


def _merged(children: Column) -> Column:
    """Siblings, the largest first, each put into the first class of branches like it."""
    ddl = "struct<tokens: array<string>, n: bigint, lab: bigint, bad: bigint, next: map<string, bigint>>"
    add = lambda g, c: F.struct(
        F.concat(g["tokens"], c["tokens"]).alias("tokens"), (g["n"] + c["n"]).alias("n"), (g["lab"] + c["lab"]).alias("lab"), (g["bad"] + c["bad"]).alias("bad"),
        F.transform_values(F.map_from_arrays(F.array_union(F.map_keys(g["next"]), F.map_keys(c["next"])), F.array_union(F.map_keys(g["next"]), F.map_keys(c["next"]))), lambda t, _: F.coalesce(F.try_element_at(g["next"], t), F.lit(0)) + F.coalesce(F.try_element_at(c["next"], t), F.lit(0))).alias("next"),
    )
    first = lambda groups, c: F.coalesce(F.array_min(F.filter(F.transform(groups, lambda g, i: F.when(_alike(g, c), i)), lambda i: i.isNotNull())), F.lit(-1))

    def step(groups, c):
        # an array of one number, so that the place is looked for once
        return F.aggregate(F.array(first(groups, c)), groups, lambda _, at: F.when(at < 0, F.concat(groups, F.array(c))).otherwise(F.transform(groups, lambda g, i: F.when(i == at, add(g, c)).otherwise(g))))

    return F.aggregate(children, F.array().cast(f"array<{ddl}>"), step)


def template_tree(leaves: DataFrame, depth: int) -> DataFrame:
    """``(host, tokens, n, template, purity, own_bad)`` of rows ``(host, tokens, n, lab, bad)``, one for
    each host and token list: the tree from the root down, with merged siblings; ``own_bad`` counts the template's bad labels.

    A parent has at most 2 / SHARE + 2 children, so what is gathered for one is bounded."""
    total = leaves.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("lab"), F.lit(0)), F.lit(0.0)).alias("all"))
    smooth = lambda bad, lab, above: (bad + PRIOR * above) / (lab + PRIOR)
    hosts = leaves.groupBy("host").agg(F.sum("lab").alias("l"), F.sum("bad").alias("own")).join(F.broadcast(total))  # total is one row
    hosts = hosts.select("host", smooth(F.col("own"), F.col("l"), F.col("all")).alias("p"), "own")
    rows = staged(leaves.join(hosts, "host").withColumn("node", F.lit("")), "tree")
    for level in range(depth):
        inner = rows.filter(F.size("tokens") > level)
        token, after = F.col("tokens")[level], F.coalesce(F.get("tokens", F.lit(level + 1)), F.lit("/"))
        sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
        # the first grouping has all keys of the later ones in the partitions of a host
        each = inner.repartition("host").groupBy("host", "node", token.alias("token"), after.alias("after")).agg(*sums, F.max("p").alias("p"))
        child = each.groupBy("host", "node", "token").agg(*sums, F.max("p").alias("p"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("after", "n")))).alias("next"))
        order = F.struct((-F.col("n")).alias("rank"), "token", F.struct(F.array("token").alias("tokens"), "n", "lab", "bad", "next").alias("c"))
        # sorted by number and token, which are unique, as maps can't be compared
        parents = child.groupBy("host", "node").agg(F.max("p").alias("p"), F.array_sort(F.collect_list(order), lambda a, b: F.when(a["rank"] != b["rank"], F.signum(a["rank"] - b["rank"]).cast("int")).when(a["token"] < b["token"], -1).when(a["token"] > b["token"], 1).otherwise(0)).alias("children"))
        classes = parents.select("host", "node", "p", F.explode(_merged(F.transform("children", lambda x: x["c"]))).alias("g"))
        named = classes.select("host", "node", F.concat(F.col("node"), F.lit("/"), F.array_join(F.sort_array("g.tokens"), "|")).alias("to"), smooth(F.col("g.bad"), F.col("g.lab"), F.col("p")).alias("q"), F.col("g.bad").alias("ours"), F.explode("g.tokens").alias("token"))
        here = rows.withColumn("token", F.get("tokens", F.lit(level)))
        rows = staged(here.join(named, ["host", "node", "token"], "left").select("host", "tokens", "n", "lab", "bad", F.coalesce("q", "p").alias("p"), F.coalesce("ours", "own").alias("own"), F.coalesce("to", "node").alias("node")), "tree")
    return rows.select("host", "tokens", "n", F.when(F.col("node") == "", "/").otherwise(F.col("node")).alias("template"), (1 - F.col("p")).alias("purity"), F.col("own").alias("own_bad"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each page: ``key``, ``host``, ``path``, ``rule`` and ``verdict`` (the
    rule's, where one fits, else ``block`` if ``purity`` is below LEAST_PURITY and a page of
    the template has a bad label, else ``allow``), ``template`` and ``purity`` of its template.

    ``labels(key, bad)`` marks some pages, true for bad ones; several labels of a page count as
    one, bad if any is.  All pages, those with a rule too, are counted in the tree.  Without any
    label nothing is blocked by purity.  A null URL or one without ``://`` has an empty host
    and path; pages with a null key have no label; repeated rows are judged like any other;
    further columns are ignored; an empty table gives no rows."""
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("u"))
    host, path = host_and_path(F.col("u"))
    rows = rows.select("id", host.alias("host"), path.alias("path")).withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.max(F.col("bad").cast("int")).alias("bad"), F.lit(0).alias("salt"))
    # rows without an id are dealt by their path instead of meeting in one task
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("host", "path"), F.lit(4096)) + 1).otherwise(0).cast("int")).withColumn("at", F.coalesce("id", F.lit(0).cast(dict(rows.dtypes)["id"])))
    rows = staged(salted.join(marks.withColumnRenamed("id", "at"), ["at", "salt"], "left").drop("at", "salt"), "urls")
    total = rows.count()
    rows = staged(joined(rows, vocabularies(rows), ["host"], "rows", total).select("id", "host", "path", template_tokens(F.col("segments"), F.col("vocabulary")).alias("tokens"), "bad"), "tokens")
    leaves = staged(rows.groupBy("host", "tokens").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "leaves")
    depth = leaves.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()[0]
    out = joined(rows, template_tree(leaves, depth), ["host", "tokens"], "n", total)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    blocked = F.when((F.col("purity") < LEAST_PURITY) & (F.col("own_bad") > 0), "block").otherwise("allow")
    return out.withColumn("r", rule).select(F.col("id").alias(key), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", blocked).alias("verdict"), "template", "purity")
