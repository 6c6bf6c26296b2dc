"""URL filters by rules and by trust and distrust over links of hosts (operator 11); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protospark.llm.common import cut, table

#: (verdict, host, path): a rule fits a url of the host or a subdomain whose path starts so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Whole trust, and whole distrust, in units: sums of integers don't depend on their order, so reruns agree to the last unit.
WHOLE = 10**18
#: Of a host's trust, what its links pass on in a round (in percent), and rounds.
DAMPING, ROUNDS = 85, 20
#: Rounds between two writes to the shared folder.
WRITE_EVERY = 5
#: Edges of one host that meet its trust in one task; blocked hosts that may be broadcast, and parts that pages are dealt to beyond.
EDGES, BROADCAST_HOSTS, PARTS = 1 << 16, 1 << 20, 64
#: A link to a host: scheme (or none), two slashes, host.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>\\]+)"""


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    whole = "^([^/?#]*)([^?#]*)"
    return lower(F.regexp_extract(rest, whole, 1)), F.regexp_extract(rest, whole, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (ties: the smaller text, then verdict); nulls if none does."""
    known = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in known]
    none = F.lit(None).cast("string")
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values)), none)
    return pick([h + p for _, h, p in known]), pick([v for v, _, _ in known])


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: pages of host ``src`` that link to host ``dst``.

    A page links to the hosts of its absolute links, each once however often it names them, and to its own host (all relative links).
    """
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), lower)
    told = pages.select(F.col("host").alias("src"), F.explode(F.array_union(F.array("host"), links)).alias("dst"))
    return told.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust``, in parts of ``WHOLE``: personalised PageRank from ``seeds`` (``host, allowed, blocked``: pages).

    Trust starts at hosts in proportion to their allowed pages, and follows links; distrust starts at hosts in proportion to blocked pages, and goes against them.
    In each round a host passes ``DAMPING`` percent of what it has to its neighbours, in proportion to weights, and the seeds give the rest anew.
    A host without a link in that direction keeps its part. Both directions are one table, so a round is one join and one sum.
    A host with many edges meets its trust in parts, by its neighbour's hash; sums are made before the shuffle, so a host that many link to is no hot key.
    """
    both = edges.select(F.lit(False).alias("back"), "src", "dst", "weight").union(edges.select(F.lit(True), F.col("dst"), F.col("src"), F.col("weight")))
    nodes = both.select("back", F.col("dst").alias("src")).union(seeds.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.col("host").alias("src"))).distinct()
    out = both.groupBy("back", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("many"))
    ends = nodes.join(out, ["back", "src"], "left_anti").select("back", "src", F.col("src").alias("dst"), F.lit(1).cast("long").alias("weight"))
    own = ends.select("back", "src", F.col("weight").alias("out"), F.lit(1).cast("long").alias("many"))
    out = cut(out.union(own).withColumn("parts", F.ceil(F.col("many") / EDGES).cast("int")).drop("many"))
    linked = both.union(ends).join(out, ["back", "src"]).withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"))
    linked = cut(linked.select("back", "src", "part", "dst", "weight", "out", "parts"))
    total = seeds.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("a"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    share = lambda c, n: F.expr(f"{WHOLE} div {n} * {c}") if n else F.lit(0).cast("long")
    start = cut(seeds.select("host", F.explode(F.array(F.struct(F.lit(False).alias("back"), share("allowed", total.a).alias("have")), F.struct(F.lit(True).alias("back"), share("blocked", total.b).alias("have")))).alias("s"))
                .select("s.back", F.col("host").alias("src"), "s.have").where("have > 0").join(out, ["back", "src"]).select("back", "src", "have", "parts"))
    anew = start.select("back", "src", F.expr(f"have div 100 * {100 - DAMPING}").alias("have"), "parts")
    now = start
    for i in range(rounds):
        dealt = now.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        passed = linked.join(dealt, ["back", "src", "part"]).select("back", F.col("dst").alias("src"), F.expr(f"have div 100 * {DAMPING} div out * weight").alias("have"))
        now = passed.union(anew.drop("parts")).groupBy("back", "src").agg(F.sum("have").alias("have")).where("have > 0")
        now = now.join(out.drop("out"), ["back", "src"])
        if (i + 1) % WRITE_EVERY == 0:
            now = cut(now)
    return now.groupBy(F.col("src").alias("host")).agg(F.coalesce(F.sum(F.when(~F.col("back"), F.col("have"))), F.lit(0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("back"), F.col("have"))), F.lit(0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages`` (``page_id, url, html``).

    A rule decides its urls (the longest that fits). Hosts of allowed pages are trusted seeds and those of blocked pages distrusted seeds, by the number of such
    pages; trust follows links between hosts and distrust goes against them. A host is blocked (for urls that no rule fits) when its distrust exceeds both
    its trust and its share of all pages, that is when more distrust reaches it than its size explains; else it is allowed.

    Null urls, and those without ``://``, have an empty host and path, are no host of the graph, and are allowed. Null html has no links; rows with null or
    repeated ids are pages of their own; without pages there are no rows. ``rules`` is a short list of the caller's.
    Pages are not shuffled with their html: only sums by host and pair of hosts are. Blocked hosts are broadcast if they are few, else joined in ``PARTS`` parts a host.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    told = told.select("page_id", "host", "path", "html", rule.alias("rule"), verdict.alias("ruled"))
    some = told.where("host <> ''")
    counts = cut(some.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    every = counts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    flow = propagate(cut(host_edges(some)), counts.select("host", "allowed", "blocked"), rounds)
    bad = flow.join(counts, "host").where("distrust > trust").where(F.expr(f"distrust > {WHOLE} div {max(1, every)} * pages"))
    bad = cut(bad.where("allowed + blocked < pages").select("host"))
    plain = told.drop("html")
    if bad.count() <= BROADCAST_HOSTS:
        plain = plain.join(F.broadcast(bad.withColumn("bad", F.lit(True))), "host", "left")
    else:
        parts = bad.select("host", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(True).alias("bad"))
        plain = plain.withColumn("part", F.pmod(F.xxhash64("page_id", "path"), F.lit(PARTS)).cast("int")).join(parts, ["host", "part"], "left")
    return plain.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql(rules=RULES, rounds: int = ROUNDS) -> str:
    known = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    case = lambda of: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{of(v, h, p)}'" for v, h, p in known) + " end"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    link = LINK.replace("'", "''")
    steps = "".join(
        f"""n{i + 1} as materialized (select back, src, sum(have)::bigint have from (
  select n.back, e.dst src, have // 100 * {DAMPING} // o * w have from n{i} n join e on n.back = e.back and n.src = e.src union all select back, src, have // 100 * {100 - DAMPING} from n0) group by 1, 2),
"""
        for i in range(rounds)
    )
    return rf"""
with u as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r from pages),
x as (select page_id, html, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), {letters}) host, regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) path from u),
p as (select page_id, html, host, path, {case(lambda v, h, p: h + p)} as rule, {case(lambda v, h, p: v)} ruled from x),
c as (select host, count(*) pages, count(*) filter (ruled = 'allow') a, count(*) filter (ruled = 'block') b from p where host <> '' group by host),
l as (select host src, unnest(list_distinct(list_concat([host], list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda y: translate(y, {letters}))))) dst from p where host <> ''),
d as (select src, dst, count(*) w from l group by 1, 2),
b as (select false back, src, dst, w from d union all select true, dst, src, w from d),
z as (select back, dst src from b union select back, host from c, (values (false), (true)) t(back)),
f as (select * from b union all select back, src, src, 1 from z where (back, src) not in (select (back, src) from b)),
e as materialized (select *, sum(w) over (partition by back, src)::bigint o from f),
n0 as materialized (select back, host src, case when back then {WHOLE} // nullif(tb, 0) * b else {WHOLE} // nullif(ta, 0) * a end::bigint have
  from c, (select sum(a)::bigint ta, sum(b)::bigint tb from c), (values (false), (true)) t(back) where case when back then b else a end > 0),
{steps}g as (select host, pages, coalesce(sum(have) filter (not back), 0)::bigint trust, coalesce(sum(have) filter (back), 0)::bigint distrust from c left join n{rounds} n on n.src = c.host group by 1, 2),
h as (select host from g where distrust > trust and distrust > {WHOLE} // (select sum(pages) from c)::bigint * pages)
select page_id, host, path, rule, coalesce(ruled, case when host in (select host from h) then 'block' else 'allow' end) verdict from p
"""


OP11_SQL = _sql()
