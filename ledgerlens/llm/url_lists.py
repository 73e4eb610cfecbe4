"""Temporal URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

A list is a history of changes (list_name, pattern, action, change, changed_at): ``change`` is add or
remove, ``action`` block or allow.  A window turns each addition into an interval up to the next change of the
same entry.  A pattern is a domain (it covers its subdomains) or a host with a path prefix by whole
segments.  A capture's URL is turned into the keys that could match (the host, its parent domains, the
host with each path prefix), keys meet patterns in an equality join, and the interval test keeps what
was active at fetch time.  The most specific active entry decides; ties go to allow, then to the latest
start, then to the list's and pattern's order.

A host with a third of all captures is spread by a salt; the list's intervals are repeated per salt.
Times are whole seconds since 1970.  Everything is DataFrame and SQL functions.

Defined cases: a null or unparsable URL has no host and decision "none"; a null fetch time matches nothing;
changes with a null pattern or time are ignored; of changes at the same time a removal comes last;
captures repeated with the same id, URL and time are one row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
FIRST_SECOND, DAY = 1704067200, 86400


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(found, r"[.]+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys(host: str, path: str) -> Column:
    """All patterns that would match: parent domains of two labels or more, the host, host and path prefixes."""
    return F.expr(f"""
      case when {host} = '' then cast(array() as array<string>) else array_distinct(concat(
        array({host}),
        transform(sequence(1, greatest(size(split({host}, '[.]')) - 1, 1)),
                  i -> array_join(slice(split({host}, '[.]'), i, size(split({host}, '[.]'))), '.')),
        transform(sequence(1, size(filter(split({path}, '/'), s -> s <> '')), 1),
                  i -> concat({host}, '/', array_join(slice(filter(split({path}, '/'), s -> s <> ''), 1, i), '/')))))
      end""")


def _keys(captures: DataFrame) -> DataFrame:
    # sequence(1, 0) would count down; a URL without path segments has no prefixes.
    some = F.expr("size(filter(split(path, '/'), s -> s <> '')) > 0")
    bare = F.expr("""case when host = '' then cast(array() as array<string>) else array_distinct(concat(array(host),
        transform(sequence(1, greatest(size(split(host, '[.]')) - 1, 1)),
                  i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.')))) end""")
    return captures.withColumn("keys", F.when(some, keys("host", "path")).otherwise(bare))


def intervals(changes: DataFrame) -> DataFrame:
    """(list_name, pattern, action, valid_from, valid_to): valid_to is exclusive, null while the entry stands."""
    order = Window.partitionBy("list_name", "pattern", "action").orderBy("changed_at", "change")
    known = changes.where("pattern is not null and changed_at is not null")
    return known.select("*", F.lead("changed_at").over(order).alias("valid_to")).where(
        "change = 'add' and (valid_to is null or valid_to > changed_at)").select(
        "list_name", "pattern", "action", F.col("changed_at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """(page_id, url, host, fetched_at, decision, list_name, pattern, valid_from) for each capture (page_id, url, fetched_at)."""
    named = captures.select("page_id", "url", "fetched_at").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    wanted = _keys(named).select(
        "page_id", "url", "fetched_at", "host", F.explode_outer("keys").alias("key"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    listed = intervals(changes).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    active = (
        (F.col("key") == F.col("pattern")) & (F.col("salt") == F.col("salt_")) & (F.col("valid_from") <= F.col("fetched_at"))
        & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    rank = F.struct(
        F.length("pattern").alias("n"), (F.col("action") == "allow").alias("allow"), "valid_from", "list_name", "pattern", "action")
    best = wanted.join(listed, active, "left").groupBy("page_id", "url", "host", "fetched_at").agg(
        F.max(F.when(F.col("pattern").isNotNull(), rank)).alias("best"))
    return best.select("page_id", "url", "host", "fetched_at", F.coalesce("best.action", F.lit("none")).alias("decision"),
                       "best.list_name", "best.pattern", "best.valid_from")


def _part(of: Column, at: int) -> Column:
    """Two hex digits of the md5 of a text as a number."""
    return F.conv(F.substring(F.md5(of), 2 * at + 1, 2), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at): the test tables hold no fetch time, so it follows from the id."""
    name = F.col("page_id").cast("string")
    day = _part(name, 0) + _part(name, 1)
    return pages.select("page_id", "url", (FIRST_SECOND + day * DAY + _part(name, 2) * 300).alias("fetched_at"))


def changes_of(pages: DataFrame) -> DataFrame:
    """A list history over the hosts, parent domains and first path segments of ``pages``, following from their names."""
    named = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct().where("host <> ''")
    first = F.regexp_extract("path", "^/([^/]+)", 1)
    parent = F.regexp_replace("host", "^[^.]+[.]", "")
    patterns = named.select(F.explode(F.array(
        F.col("host"), F.when(parent.contains("."), parent), F.when(first != "", F.concat("host", F.lit("/"), first)))).alias("pattern"))
    patterns = patterns.where("pattern is not null").distinct()
    p = F.col("pattern")
    listed = patterns.where(_part(p, 0) < 128).select(
        "pattern", F.when(_part(p, 4) < 100, "editorial").otherwise("crawl").alias("list_name"),
        F.when(_part(p, 1) < 160, "block").otherwise("allow").alias("action"),
        (FIRST_SECOND + _part(p, 2) * DAY).alias("added"), (FIRST_SECOND + (_part(p, 2) + _part(p, 3) + 20) * DAY).alias("removed"),
        _part(p, 1).alias("kind"))
    change = lambda name, at: F.struct(F.lit(name).alias("change"), at.alias("changed_at"))
    return listed.select("list_name", "pattern", "action", F.explode(F.array(
        change("add", F.col("added")), F.when(F.col("kind") % 3 != 0, change("remove", F.col("removed"))),
        F.when(F.col("kind") % 5 == 0, change("add", F.col("removed") + 30 * DAY)))).alias("c")).where("c is not null").select(
        "list_name", "pattern", "action", "c.change", "c.changed_at")


ORACLE = r"""
with named as (
  select page_id, url,
    coalesce(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]+$', ''), '') as host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') as path, md5(page_id::varchar) as m
  from pages),
caps as (
  select *, 1704067200 + (('0x' || substr(m, 1, 2))::bigint + ('0x' || substr(m, 3, 2))::bigint) * 86400
            + ('0x' || substr(m, 5, 2))::bigint * 300 as fetched_at,
    list_filter(string_split(path, '/'), lambda s: s <> '') as segs, string_split(host, '.') as labels from named),
pats as (
  select distinct unnest([host, case when contains(regexp_replace(host, '^[^.]+[.]', ''), '.') then regexp_replace(host, '^[^.]+[.]', '') end,
    case when regexp_extract(path, '^/([^/]+)', 1) <> '' then host || '/' || regexp_extract(path, '^/([^/]+)', 1) end]) as pattern
  from caps where host <> ''),
parts as (
  select pattern, ('0x' || substr(md5(pattern), 1, 2))::bigint p0, ('0x' || substr(md5(pattern), 3, 2))::bigint p1,
    ('0x' || substr(md5(pattern), 5, 2))::bigint p2, ('0x' || substr(md5(pattern), 7, 2))::bigint p3,
    ('0x' || substr(md5(pattern), 9, 2))::bigint p4 from pats where pattern is not null),
listed as (
  select pattern, case when p4 < 100 then 'editorial' else 'crawl' end as list_name, case when p1 < 160 then 'block' else 'allow' end as action,
    1704067200 + p2 * 86400 as added, 1704067200 + (p2 + p3 + 20) * 86400 as removed, p1 from parts where p0 < 128),
spans as (
  select list_name, pattern, action, added as valid_from, case when p1 % 3 <> 0 then removed
    when p1 % 5 = 0 then removed + 30 * 86400 end as valid_to from listed
  union all select list_name, pattern, action, removed + 30 * 86400, null from listed where p1 % 5 = 0),
keyed as (
  select distinct page_id, url, host, fetched_at, key from (
    select page_id, url, host, fetched_at, unnest(list_concat(
      [array_to_string(labels[i:], '.') for i in range(1, greatest(len(labels), 2))],
      [host || '/' || array_to_string(segs[1:i], '/') for i in range(1, len(segs) + 1)])) as key
    from caps where host <> '')),
ranked as (
  select k.page_id, s.*, row_number() over (partition by k.page_id order by length(s.pattern) desc, (s.action = 'allow') desc,
    s.valid_from desc, s.list_name desc, s.pattern desc) as r
  from keyed k join spans s on k.key = s.pattern and s.valid_from <= k.fetched_at and (s.valid_to is null or k.fetched_at < s.valid_to))
select c.page_id, c.url, c.host, c.fetched_at, coalesce(r.action, 'none') as decision, r.list_name, r.pattern, r.valid_from
from caps c left join ranked r on c.page_id = r.page_id and r.r = 1
"""
