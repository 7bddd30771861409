"""Registered queries on catalogues, each beside its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogkit.functions import phrases, text
from catalogkit.functions.empty import has_value, is_blank, is_unset
from catalogkit.operators import audit, digests, index, mapping, merge, names, ordered, postings, rename, select, serving, tags
from catalogkit.plans.adapters import oracle_views, spread, view
from catalogkit.sources import io, pages, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ROLES = merge.Roles(cast="members")
AS_OF = "2001-06-01"


def register(sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if not uses:
                ORACLE_SQL[f.__name__] = body
            elif body.upper().startswith("WITH "):
                ORACLE_SQL[f.__name__] = oracle_views(*uses) + ",\n" + body[5:]
            else:
                ORACLE_SQL[f.__name__] = oracle_views(*uses) + "\n" + body
        return f

    return add


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


NORMAL = """CASE WHEN regexp_matches(upper(trim(raw)), '^[A-Z]{2,10}[-_]?[0-9]{2,5}$')
    THEN regexp_extract(upper(trim(raw)), '^([A-Z]+)', 1) || '-' || CAST(CAST(regexp_extract(raw, '([0-9]+)', 1) AS INT) AS VARCHAR) ELSE upper(trim(raw)) END"""


@register(f"SELECT k, {NORMAL} AS code, CASE WHEN regexp_matches(lower({NORMAL}), '^[a-z0-9_]{{7,19}}$') THEN 'cid' ELSE 'normal' END AS kind FROM items", ("items",))
def canon_codes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").select("k", text.normalize_id(F.col("raw")).alias("code"), text.guess_id_type(F.col("raw")).alias("kind"))


@register(
    """SELECT k, CASE WHEN position('-' IN u) > 0 THEN u ELSE regexp_replace(u, '^([A-Z]+)([0-9]+)$', '\\1-\\2') END AS split_code,
              regexp_replace(upper(trim(raw)), '[\\s_]+', '-', 'g') AS plain_code,
              upper(regexp_extract(raw, '([A-Za-z]{2,8})[_ -]?([0-9]{2,5})', 1)) || '-' || regexp_extract(raw, '([A-Za-z]{2,8})[_ -]?([0-9]{2,5})', 2) AS found,
              CAST(regexp_extract(code, '-([0-9]+)$', 1) AS BIGINT) AS number
       FROM (SELECT *, translate(upper(trim(raw)), ' _.', '---') AS u FROM items)""",
    ("items",),
)
def canon_variants(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return view(spark, d, "items").select(
        "k", text.canon_code(raw).alias("split_code"), text.canon_code(raw, split=False).alias("plain_code"), text.extract_code(raw).alias("found"), text.parse_code(F.col("code"))["number"].alias("number")
    )


MISSING = """concat_ws('|', CASE WHEN title IS NULL OR title = '' THEN 'title' END, CASE WHEN cover IS NULL OR cover = '' THEN 'cover' END,
    CASE WHEN date IS NULL OR date = '' THEN 'date' END, CASE WHEN owner IS NULL OR owner = '' THEN 'owner' END)"""


@register(f"SELECT code, {MISSING} AS missing, {MISSING} <> '' AS incomplete FROM items", ("items",))
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return audit.annotate_completeness(view(spark, d, "items")).select("code", joined("missing_fields").alias("missing"), "incomplete")


@register(f"SELECT field, count(*) AS n FROM (SELECT unnest(string_split({MISSING}, '|')) AS field FROM items) WHERE field <> '' GROUP BY field", ("items",))
def missing_hist(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing_histogram(audit.annotate_completeness(view(spark, d, "items")))


COVERED = ("title", "date", "owner", "maker", "rating", "tags", "cover")
_COVER = {"rating": "rating <> 0", "tags": "len(tags) > 0"}


@register(
    "\nUNION ALL\n".join(
        f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IS NOT NULL AND {_COVER.get(f, f + chr(60) + chr(62) + chr(39) * 2)}) AS present, count(*) AS total, "
        f"100 * count(*) FILTER (WHERE {f} IS NOT NULL AND {_COVER.get(f, f + chr(60) + chr(62) + chr(39) * 2)}) // count(*) AS pct FROM items"
        for f in COVERED
    ),
    ("items",),
)
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.field_coverage(view(spark, d, "items"), COVERED)


@register(
    """SELECT code, title IS NOT NULL AND title <> '' AS has_title, title IS NULL OR lower(trim(title)) IN ('', 'null', 'none', 'n/a') AS blank_title,
              title IS NULL OR title = '' AS unset_title, rating <> 0 AS has_rating, FALSE AS blank_rating FROM items""",
    ("items",),
)
def emptiness_matrix(spark: SparkSession, d: str) -> DataFrame:
    s, n, t, r = T.StringType(), T.DoubleType(), F.col("title"), F.col("rating")
    return view(spark, d, "items").select(
        "code", has_value(t, s).alias("has_title"), is_blank(t, s).alias("blank_title"), is_unset(t, s).alias("unset_title"), has_value(r, n).alias("has_rating"), is_blank(r, n).alias("blank_rating")
    )


def _blank(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ('', 'null', 'none', 'n/a'))"


def _fill(old: str, new: str) -> str:
    return f"CASE WHEN {_blank(old)} AND NOT {_blank(new)} THEN {new} ELSE {old} END"


@register(
    f"""WITH o AS (SELECT * FROM observations WHERE source = 'beta'), m AS (
            SELECT i.code, i.title AS t0, i.maker AS m0, i.date AS d0, i.source AS s0, {_fill('i.title', 'o.title')} AS title, {_fill('i.maker', 'o.maker')} AS maker, {_fill('i.date', 'o.date')} AS date,
                   CASE WHEN i.source IS NULL OR i.source = 'pending' THEN coalesce(o.source, i.source) ELSE i.source END AS source
            FROM items i LEFT JOIN o ON o.code = i.code)
        SELECT code, title, maker, date, source, concat_ws('|', CASE WHEN t0 IS DISTINCT FROM title THEN 'title' END, CASE WHEN m0 IS DISTINCT FROM maker THEN 'maker' END,
               CASE WHEN d0 IS DISTINCT FROM date THEN 'date' END, CASE WHEN s0 IS DISTINCT FROM source THEN 'source' END) AS changed_keys FROM m""",
    ("items", "observations"),
)
def fill_merge(spark: SparkSession, d: str) -> DataFrame:
    beta = view(spark, d, "observations").where("source = 'beta'")
    out = merge.fill_merge(view(spark, d, "items"), beta, ["title", "maker", "date", "source"], ROLES)
    return out.select("code", "title", "maker", "date", "source", joined("changed_keys").alias("changed_keys"))


_CHAIN = """WITH a0 AS (SELECT i.code, i.title AS t, i.maker AS m, '' AS by_, FALSE AS stop FROM items i)"""
for _n, _s in enumerate(("alpha", "beta", "gamma")):
    _t, _m = _fill("a.t", "o.title"), _fill("a.m", "o.maker")
    _CHAIN += f""", b{_n} AS (SELECT a.*, CASE WHEN a.stop OR o.code IS NULL THEN a.t ELSE {_t} END AS t1, CASE WHEN a.stop OR o.code IS NULL THEN a.m ELSE {_m} END AS m1
        FROM a{_n} a LEFT JOIN observations o ON o.code = a.code AND o.source = '{_s}'),
        c{_n} AS (SELECT *, t1 IS DISTINCT FROM t OR m1 IS DISTINCT FROM m AS changed FROM b{_n}),
        a{_n + 1} AS (SELECT code, t1 AS t, m1 AS m, CASE WHEN changed THEN by_ || '{_s}|' ELSE by_ END AS by_, stop OR (changed AND NOT {_blank('t1')} AND NOT {_blank('m1')}) AS stop FROM c{_n})"""


@register(_CHAIN + " SELECT code, t AS title, m AS maker, rtrim(by_, '|') AS filled_from FROM a3", ("items", "observations"))
def chain_fill(spark: SparkSession, d: str) -> DataFrame:
    out = merge.chain_fill(view(spark, d, "items"), view(spark, d, "observations"), ["title", "maker"], ["title", "maker"], roles=ROLES)
    return out.select("code", "title", "maker", joined("filled_from").alias("filled_from"))


@register(
    f"""SELECT code, arg_min(title, priority) FILTER (WHERE NOT {_blank('title')}) AS title, arg_min(maker, priority) FILTER (WHERE NOT {_blank('maker')}) AS maker,
               arg_min(date, priority) FILTER (WHERE NOT {_blank('date')}) AS date FROM observations GROUP BY code""",
    ("observations",),
)
def priority_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.priority_merge(view(spark, d, "observations"), ["title", "maker", "date"])


@register(f"SELECT code, source FROM items WHERE {_blank('title')} OR source IS NULL OR source = 'pending'", ("items",))
def select_targets(spark: SparkSession, d: str) -> DataFrame:
    return select.select_targets(view(spark, d, "items")).select("code", "source")


@register("SELECT code FROM items WHERE source IS DISTINCT FROM 'alpha' AND (title IS NULL OR title = '' OR date IS NULL)", ("items",))
def resume_filter(spark: SparkSession, d: str) -> DataFrame:
    return select.with_gaps(select.resume_filter(view(spark, d, "items"), "alpha"), ["title", "date"]).select("code")


@register(
    """WITH o AS (SELECT code, date, 'Supplier#' || lpad(CAST(priority * 7 AS VARCHAR), 9, '0') AS owner FROM observations WHERE source = 'gamma')
       SELECT i.code, CASE WHEN (i.owner IS NULL OR i.owner = '') AND c.name IS NOT NULL THEN o.owner ELSE i.owner END AS owner,
              CASE WHEN (i.date IS NULL OR i.date = '') AND o.date <> '' THEN o.date ELSE i.date END AS date,
              concat_ws('|', CASE WHEN (i.owner IS NULL OR i.owner = '') AND c.name IS NOT NULL THEN 'owner' END, CASE WHEN (i.date IS NULL OR i.date = '') AND o.date <> '' THEN 'date' END) AS filled
       FROM items i LEFT JOIN o ON o.code = i.code LEFT JOIN curated c ON c.name = o.owner""",
    ("items", "observations", "curated"),
)
def curated_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    seen = view(spark, d, "observations").where("source = 'gamma'").withColumn("owner", F.concat(F.lit("Supplier#"), F.lpad((F.col("priority") * 7).cast("string"), 9, "0")))
    out = merge.gap_fill(view(spark, d, "items"), seen, ["owner", "date"], select.curated(view(spark, d, "curated"), ["other"]), ROLES)
    return out.select("code", "owner", "date", joined("filled").alias("filled"))


@register(
    """SELECT name, CASE WHEN avatar = '' THEN 'https://new.example.com/' || name ELSE avatar END AS avatar, coalesce(team, 'T') AS team,
              concat_ws('|', CASE WHEN team IS NULL THEN 'team' END, CASE WHEN avatar = '' THEN 'avatar' END) AS changed_keys FROM profiles""",
    ("profiles",),
)
def profile_fill(spark: SparkSession, d: str) -> DataFrame:
    own = view(spark, d, "profiles")
    fetched = own.select("name", F.lit("T").alias("team"), F.concat(F.lit("https://new.example.com/"), "name").alias("photo"))
    out = merge.profile_fill(own, fetched, ["team"], aliases=None)
    return out.select("name", "avatar", "team", joined("changed_keys").alias("changed_keys"))


@register(
    """WITH n AS (SELECT s_name AS name, 'https://a.example.com/' || s_suppkey AS avatar FROM supplier WHERE s_acctbal > 0)
       SELECT coalesce(p.name, n.name) AS name, coalesce(n.avatar, p.avatar) AS avatar,
              CASE WHEN p.name IS NULL THEN 'created' WHEN n.avatar IS NOT NULL AND n.avatar IS DISTINCT FROM p.avatar THEN 'updated' ELSE 'skipped' END AS action
       FROM profiles p FULL JOIN n ON n.name = p.name""",
    ("profiles",),
)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    fresh = view(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("name"), F.concat(F.lit("https://a.example.com/"), "s_suppkey").alias("avatar"))
    return merge.upsert(view(spark, d, "profiles"), fresh, "name", "avatar")


@register(
    """SELECT code, coalesce(nullif(cover, ''), 'https://n.example.com/' || code) AS cover, coalesce(nullif(cover, ''), 'https://n.example.com/' || code) AS poster,
              's1/' || code AS background, 's1/' || code || '|s2' AS samples FROM items""",
    ("items",),
)
def image_merge(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items").select("code", "cover", F.lit("").alias("poster"), F.lit(None).cast("string").alias("background"), F.array().cast("array<string>").alias("sample_images"))
    found = items.select("code", F.lit(2).alias("priority"), F.concat(F.lit("https://n.example.com/"), "code").alias("cover"), F.array(F.concat(F.lit("s1/"), "code"), F.lit("s2")).alias("samples"))
    none = found.select("code", F.lit(1).alias("priority"), "cover", F.array().cast("array<string>").alias("samples"))
    return merge.image_merge(items, found.unionByName(none)).select("code", "cover", "poster", "background", joined("sample_images").alias("samples"))


@register(
    """WITH c AS (SELECT code, owner, source, list_distinct(members) AS m, coalesce(owner, '') <> '' AND NOT list_contains(members, owner) AS conflict FROM items),
            o AS (SELECT *, CASE WHEN NOT conflict THEN 'ok' WHEN len(m) > 1 THEN 'flagged' WHEN source = 'alpha' THEN 'protected' ELSE 'fixed' END AS outcome FROM c)
       SELECT code, outcome, CASE WHEN outcome = 'fixed' THEN m[1] ELSE owner END AS owner, CASE WHEN outcome = 'fixed' AND (source IS NULL OR source = 'pending') THEN 'attribution_fix' ELSE source END AS source FROM o""",
    ("items",),
)
def attribution(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items").withColumn("members", F.array_distinct("members"))
    return audit.fix_attribution(items, ["alpha"], roles=ROLES).select("code", "outcome", "owner", "source")


@register(
    """SELECT i.code, i.owner AS stored, o.owner AS observed, CASE WHEN coalesce(o.owner, '') = '' THEN 'no_data' WHEN o.owner = 'Supplier#000000000' THEN 'placeholder'
              WHEN coalesce(i.owner, '') = o.owner THEN 'ok' ELSE 'conflict' END AS status
       FROM items i LEFT JOIN (SELECT code, members[2] AS owner FROM items WHERE rating <> 0) o ON o.code = i.code""",
    ("items",),
)
def attribution_audit(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items")
    return audit.attribution_audit(items, items.where("rating <> 0").select("code", F.get("members", F.lit(1)).alias("owner")), ["Supplier#000000000"], ROLES)


@register(
    """SELECT ja AS key, arg_min(id, file_ord) AS id, arg_min(url, file_ord) AS url, ja, coalesce(arg_min(nullif(zh_cn, ''), file_ord) FILTER (WHERE zh_cn <> ''), ja) AS zh_cn,
              coalesce(arg_min(zh_tw, file_ord) FILTER (WHERE zh_tw <> ''), '') AS zh_tw, arg_min(en, file_ord) FILTER (WHERE en <> '') AS en,
              string_agg(note, ' / ' ORDER BY file_ord) AS note, string_agg(source, ';' ORDER BY source) AS source FROM dictionary GROUP BY ja""",
    ("dictionary",),
)
def dict_merge(spark: SparkSession, d: str) -> DataFrame:
    return tags.merge_dictionary(view(spark, d, "dictionary"), ["one", "two"])


TAG_MAP = """tm0 AS (SELECT coalesce(nullif(zh_cn, ''), nullif(zh_tw, '')) AS dst, ja, en, id, file_ord, row_ord FROM dictionary),
    tm AS (SELECT src, arg_min(dst, (file_ord, row_ord, k)) AS dst FROM (SELECT ja AS src, dst, file_ord, row_ord, 0 AS k FROM tm0 UNION ALL SELECT en, dst, file_ord, row_ord, 1 FROM tm0
           UNION ALL SELECT id, dst, file_ord, row_ord, 2 FROM tm0) WHERE dst IS NOT NULL AND src <> '' GROUP BY src)"""


@register(f"WITH {TAG_MAP} SELECT src, dst FROM tm", ("dictionary",))
def tag_map(spark: SparkSession, d: str) -> DataFrame:
    return tags.build_tag_map(view(spark, d, "dictionary"))


_TAGGED = f"WITH {TAG_MAP}, t AS (SELECT code, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM items)"


@register(f"{_TAGGED} SELECT code, string_agg(coalesce(dst, tag), '|' ORDER BY pos) AS tags_zh FROM t LEFT JOIN tm ON tm.src = t.tag GROUP BY code", ("items", "dictionary"))
def tags_aligned(spark: SparkSession, d: str) -> DataFrame:
    out = tags.translate_aligned(view(spark, d, "items").select("code", "tags"), "tags", tags.build_tag_map(view(spark, d, "dictionary")))
    return out.select("code", joined("tags_zh").alias("tags_zh"))


@register(
    f"""{_TAGGED}, u AS (SELECT code, coalesce(dst, tag) AS v, min(pos) AS pos FROM t LEFT JOIN tm ON tm.src = t.tag WHERE tag <> '' GROUP BY ALL)
        SELECT code, string_agg(v, '|' ORDER BY pos) AS tags_norm FROM u GROUP BY code""",
    ("items", "dictionary"),
)
def tags_normalised(spark: SparkSession, d: str) -> DataFrame:
    out = tags.normalize_tags(view(spark, d, "items").select("code", "tags"), "tags", tags.build_tag_map(view(spark, d, "dictionary")))
    return out.select("code", joined("tags_norm").alias("tags_norm"))


@register(f"{_TAGGED} SELECT count(dst) AS hits, count(*) AS total, round(100 * count(dst) / count(*), 2) AS pct FROM t LEFT JOIN tm ON tm.src = t.tag", ("items", "dictionary"))
def tag_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_coverage(view(spark, d, "items"), "tags", tags.build_tag_map(view(spark, d, "dictionary")))


@register(f"{_TAGGED} SELECT tag, count(*) AS n FROM t LEFT JOIN tm ON tm.src = t.tag WHERE dst IS NULL AND tag <> '' GROUP BY tag", ("items", "dictionary"))
def uncovered_tags(spark: SparkSession, d: str) -> DataFrame:
    return tags.uncovered_tags(view(spark, d, "items"), "tags", tags.build_tag_map(view(spark, d, "dictionary")))


@register(
    """WITH z AS (SELECT k, unnest(tags) AS src, generate_subscripts(tags, 1) AS pos FROM items)
       SELECT src, arg_min(upper(src) || '-' || (k % 3), (k, pos)) AS dst FROM z WHERE src <> '' GROUP BY src""",
    ("items",),
)
def global_tag_map(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items").withColumn("zh", F.transform("tags", lambda t: F.concat(F.upper(t), F.lit("-"), (F.col("k") % 3).cast("string"))))
    return tags.global_tag_map(items, "k", "tags", "zh")


CLUSTERS = """cl AS (SELECT name AS canonical, name AS alias FROM curated UNION SELECT e.canonical, e.alias FROM edges e JOIN curated c ON c.name = e.canonical
    UNION SELECT e.alias, e.canonical FROM edges e JOIN curated c ON c.name = e.alias
    UNION SELECT e.alias, f.alias FROM edges e JOIN curated c ON c.name = e.alias JOIN edges f ON f.canonical = e.canonical)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.alias_clusters(view(spark, d, "edges"), view(spark, d, "curated"))


@register(f"WITH {CLUSTERS} SELECT * FROM cl", ("edges", "curated"))
def alias_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


@register(f"WITH {CLUSTERS} SELECT alias, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS owners FROM cl GROUP BY alias HAVING count(DISTINCT canonical) > 1", ("edges", "curated"))
def alias_collisions(spark: SparkSession, d: str) -> DataFrame:
    return names.alias_collisions(_clusters(spark, d)).select("alias", joined("owners").alias("owners"))


@register(
    f"""WITH {CLUSTERS}, sure AS (SELECT alias, min(canonical) AS c FROM cl GROUP BY alias HAVING count(DISTINCT canonical) = 1), heads AS (SELECT DISTINCT canonical FROM cl)
        SELECT code, CASE WHEN h.canonical IS NOT NULL THEN owner ELSE coalesce(s.c, owner) END AS owner FROM items i LEFT JOIN sure s ON s.alias = i.owner LEFT JOIN heads h ON h.canonical = i.owner""",
    ("items", "edges", "curated"),
)
def canon_owner(spark: SparkSession, d: str) -> DataFrame:
    return names.canonicalise_owner(view(spark, d, "items"), _clusters(spark, d)).select("code", "owner")


@register(f"WITH {CLUSTERS} SELECT DISTINCT canonical FROM cl WHERE lower(alias) LIKE '%0012%'", ("edges", "curated"))
def expand_query(spark: SparkSession, d: str) -> DataFrame:
    return names.expand_query(_clusters(spark, d), "0012")


@register(
    """WITH p AS (SELECT s_name AS canonical, unnest([s_name, 'abc', lower(s_name), 'Supplier#000000001']) AS alias FROM supplier)
       SELECT DISTINCT canonical, alias FROM p WHERE alias <> canonical AND length(alias) >= 5 AND (canonical, alias) NOT IN (SELECT (canonical, alias) FROM edges)
       AND alias NOT IN (SELECT canonical FROM edges)""",
    ("edges",),
)
def alias_sync(spark: SparkSession, d: str) -> DataFrame:
    found = view(spark, d, "supplier").select(F.col("s_name").alias("name"), F.array("s_name", F.lit("abc"), F.lower("s_name"), F.lit("Supplier#000000001")).alias("aliases"))
    return names.sync_aliases(view(spark, d, "edges"), found)


LEARNED = """v AS (SELECT regexp_replace(trim(src_raw), '\\s+', ' ', 'g') AS src, dst_value AS dst, count(*) AS votes FROM pairs GROUP BY ALL),
    w AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY src) AS BIGINT) AS total, row_number() OVER (PARTITION BY src ORDER BY votes DESC, dst) AS r FROM v),
    mapped AS (SELECT src, dst, votes, total, votes / total AS share, CASE WHEN votes / total >= 0.8 THEN 'accepted' ELSE 'ambiguous' END AS status FROM w WHERE r = 1)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pairs").withColumn("src_value", text.clean_ws(F.col("src_raw")))


@register(f"WITH {LEARNED} SELECT src, dst, votes, total, round(share, 6) AS share, status FROM mapped", ("pairs",))
def learn_mapping(spark: SparkSession, d: str) -> DataFrame:
    return mapping.learn_mapping(_pairs(spark, d)).withColumn("share", F.round("share", 6))


@register(
    f"""WITH {LEARNED} SELECT code, CASE WHEN code LIKE '%3' THEN 'KEPT' ELSE m.dst END AS region, CASE WHEN code LIKE '%3' THEN 'kept' WHEN m.dst IS NOT NULL THEN 'mapped' ELSE 'unmapped' END AS outcome
        FROM pairs p LEFT JOIN mapped m ON m.src = regexp_replace(trim(p.src_raw), '\\s+', ' ', 'g') AND m.status = 'accepted'""",
    ("pairs",),
)
def apply_mapping(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    rows = pairs.select("code", "src_raw", F.when(F.col("code").endswith("3"), "KEPT").alias("region"))
    return mapping.apply_mapping(rows, mapping.learn_mapping(pairs), "src_raw", "region").select("code", "region", "outcome")


@register(f"WITH {LEARNED} SELECT u.src AS value, CAST(sum(u.votes) AS BIGINT) AS n FROM v u JOIN mapped m ON m.src = u.src AND m.status = 'ambiguous' GROUP BY u.src HAVING sum(u.votes) >= 3", ("pairs",))
def unmapped(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return mapping.unmapped(pairs, mapping.learn_mapping(pairs), "src_value", 3)


@register(f"WITH {LEARNED} SELECT v.src, string_agg(v.dst || '=' || v.votes, '|' ORDER BY v.dst) AS votes FROM v JOIN mapped m ON m.src = v.src AND m.status = 'ambiguous' GROUP BY v.src", ("pairs",))
def ambiguous_detail(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    out = mapping.ambiguous_detail(pairs, mapping.learn_mapping(pairs))
    return out.select("src", joined(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("votes"))


SHAPES = """sh AS (SELECT upper(p_type) AS prefix, '7' AS lead, CAST(5 AS INT) AS pad, CASE WHEN p_size % 3 = 0 THEN 'a/b' ELSE 'v' END AS section, 'pl' AS suffix, count(*) AS votes
    FROM part WHERE p_partkey % 8 <> 0 GROUP BY ALL),
    tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY votes DESC, section) AS r FROM sh) WHERE r = 1)"""


@register(f"WITH {SHAPES} SELECT prefix, lead, pad, section, suffix, votes FROM tp")
def learn_template(spark: SparkSession, d: str) -> DataFrame:
    return mapping.learn_template(view(spark, d, "items"), "cover", "code")


@register(
    f"""WITH {SHAPES} SELECT code, CAST(pos AS INT) AS pos, 'https://i.example.com/' || section || '/' || n || '/' || n || 'pl.jpg' AS url, kind FROM (
        SELECT p_type || '-' || p_partkey AS code, 0 AS pos, section, '7' || lower(p_type) || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS n, 'template' AS kind FROM part JOIN tp ON tp.prefix = p_type
        UNION ALL SELECT p_type || '-' || p_partkey, 1, section, '7' || lower(p_type) || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END, 'template_pad'
        FROM part JOIN tp ON tp.prefix = p_type)"""
)
def url_candidates(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items")
    return mapping.url_candidates(items, mapping.learn_template(items, "cover", "code"), "code", "https://i.example.com/", [("v", "pl", "", 3)], fixed_width=True)


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = view(spark, d, "orders")
    code, cast = F.col("o_orderkey").cast("string").alias("code"), F.array(F.col("o_orderstatus")).alias("members")
    none = F.array().cast("array<string>")
    old = orders.where("o_orderkey % 41 <> 0").select(code, F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("owner"), F.lit("s").alias("source"), F.when(F.col("o_orderkey") % 8 == 0, none).otherwise(cast).alias("members"), F.lit("t").alias("title"))
    new = orders.where("o_orderkey % 43 <> 0").select(code, F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority"))).alias("owner"), F.lit("s").alias("source"), cast, F.when(F.col("o_orderkey") % 10 == 0, "u").otherwise("t").alias("title"))
    return old, new


@register(
    """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS owner, o_orderkey % 8 = 0 AS bare FROM orders WHERE o_orderkey % 41 <> 0),
            n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS owner, o_orderkey % 10 = 0 AS titled FROM orders WHERE o_orderkey % 43 <> 0)
       SELECT CAST(coalesce(o.k, n.k) AS VARCHAR) AS code, CASE WHEN o.k IS NULL OR n.k IS NULL THEN 'error' WHEN o.bare THEN 'cast_reverted'
              WHEN o.owner IS NOT DISTINCT FROM coalesce(o.owner, n.owner) AND NOT titled THEN 'noise' WHEN o.owner IS NOT NULL AND o.owner IS DISTINCT FROM n.owner THEN 'attrib_restored' ELSE 'kept' END AS class
       FROM o FULL JOIN n ON n.k = o.k WHERE o.k IS NULL OR n.k IS NULL OR o.owner IS DISTINCT FROM n.owner OR o.bare OR titled"""
)
def snapshot_sweep(spark: SparkSession, d: str) -> DataFrame:
    return audit.sweep_snapshots(*_snapshots(spark, d), ROLES).select("code", "class")


@register(
    """SELECT code, field, string_agg(source || '=' || value, '|' ORDER BY source || '=' || value) AS by_source, count(DISTINCT value) > 1 AS conflict FROM (
           SELECT code, source, 'title' AS field, coalesce(title, '') AS value FROM observations UNION ALL SELECT code, source, 'maker', coalesce(maker, '') FROM observations) GROUP BY code, field""",
    ("observations",),
)
def source_compare(spark: SparkSession, d: str) -> DataFrame:
    return audit.compare_sources(view(spark, d, "observations"), ["title", "maker"]).withColumn("by_source", joined("by_source"))


RESOLVED = "coalesce(nullif(owner, ''), 'other')"


@register(
    f"""WITH o AS (SELECT DISTINCT {RESOLVED} AS owner, code FROM items), n AS (SELECT owner, count(*) AS work_count FROM o GROUP BY owner)
        SELECT owner, CAST(CAST('0x' || substr(md5(code), 1, 8) AS BIGINT) % greatest(CAST(ceil(work_count / 10000) AS BIGINT), 1) AS INT) AS chunk, work_count, string_agg(code, '|' ORDER BY code) AS codes
        FROM o JOIN n USING (owner) GROUP BY ALL""",
    ("items",),
)
def owner_index(spark: SparkSession, d: str) -> DataFrame:
    return index.group_index(view(spark, d, "items").drop("members").withColumn("cast", F.array().cast("array<string>"))).withColumn("codes", joined("codes"))


@register(f"SELECT {RESOLVED} AS owner, count(*) AS work_count, min(date) AS first_date, max(date) AS last_date FROM items GROUP BY 1", ("items",))
def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.entity_stats(view(spark, d, "items"))


@register(
    f"""WITH {CLUSTERS}, st AS (SELECT {RESOLVED} AS owner, count(*) AS n, min(date) AS f, max(date) AS l FROM items GROUP BY 1),
             al AS (SELECT canonical, string_agg(DISTINCT alias, '|' ORDER BY alias) AS a FROM cl WHERE alias <> canonical GROUP BY 1)
        SELECT coalesce(p.name, st.owner) AS name, CASE WHEN st.owner = 'other' AND p.name IS NULL THEN 'bucket' ELSE 'person' END AS type, coalesce(al.a, '') AS aliases,
               coalesce(st.n, 0) AS work_count, st.f AS first_date, st.l AS last_date, st.owner IS NULL AS profile_only,
               CASE WHEN p.lead LIKE '%retired%' THEN 'Retired' WHEN p.lead IS NOT NULL THEN 'open' END AS status,
               CASE WHEN p.name IS NULL THEN 'no_profile' WHEN st.owner IS NULL THEN 'no_items' ELSE '' END AS note
        FROM profiles p FULL JOIN st ON st.owner = p.name LEFT JOIN al ON al.canonical = coalesce(p.name, st.owner)""",
    ("items", "profiles", "edges", "curated"),
)
def entity_table(spark: SparkSession, d: str) -> DataFrame:
    people = view(spark, d, "profiles").withColumn("status", F.when(F.col("lead").contains("retired"), "retired").otherwise("open"))
    out = index.entity_table(people, index.entity_stats(view(spark, d, "items")), _clusters(spark, d), status_labels={"retired": "Retired", "active": "Active"})
    return out.withColumn("aliases", joined("aliases"))


@register(
    f"""WITH st AS (SELECT {RESOLVED} AS owner, min(date) AS f, max(date) AS l FROM items WHERE date IS NOT NULL GROUP BY 1)
        SELECT p.name, CASE WHEN lead LIKE '%retired%' THEN 'retired' WHEN CAST(substr(st.l, 1, 7) || '-01' AS DATE) >= DATE '{AS_OF}' - 720 THEN 'active' ELSE 'unknown' END AS status,
               CASE WHEN lead LIKE '%retired%' THEN 'inferred:lead' ELSE 'inferred' END AS status_source, st.f AS debut, CAST(substr(st.f, 1, 4) AS INT) AS debut_year
        FROM profiles p LEFT JOIN st ON st.owner = p.name""",
    ("items", "profiles"),
)
def status_inference(spark: SparkSession, d: str) -> DataFrame:
    stats = index.entity_stats(view(spark, d, "items"), dated_only=True)
    rows = view(spark, d, "profiles").join(stats, F.col("name") == F.col("owner"), "left")
    none = F.lit(None)
    rows = rows.select("name", "lead", none.cast("string").alias("tags"), none.cast("string").alias("status"), none.cast("string").alias("status_source"), "first_date", "last_date", none.cast("int").alias("debut_year"))
    return index.infer_status(rows, F.lit(AS_OF).cast("date")).select("name", "status", "status_source", "debut", "debut_year")


@register("SELECT value, count(*) AS n FROM (SELECT unnest([maker, label]) AS value FROM items) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT 80", ("items",))
def facet_browse(spark: SparkSession, d: str) -> DataFrame:
    return serving.facet_browse(view(spark, d, "items"), "maker")


@register("SELECT code FROM items WHERE list_contains(tags, 'red')", ("items",))
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    return serving.facet_filter(view(spark, d, "items"), "tag", "red").select("code")


@register("SELECT code FROM items WHERE lower(array_to_string(tags, ' ')) LIKE '%re%' AND (lower(coalesce(maker, '')) LIKE '%#1%' OR lower(label) LIKE '%#1%')", ("items",))
def combined_filter(spark: SparkSession, d: str) -> DataFrame:
    return serving.combined_filter(view(spark, d, "items"), tag=" Re ", maker="#1").select("code")


@register("SELECT code FROM items WHERE lower(code) LIKE '%mo-1%' OR lower(title) LIKE '%mo-1%' OR lower(owner) LIKE '%mo-1%' OR lower(maker) LIKE '%mo-1%'", ("items",))
def search(spark: SparkSession, d: str) -> DataFrame:
    return serving.search(serving.add_search_blob(view(spark, d, "items"), ["code", "title", "owner", "maker", "label", "series"], ["tags"]), " MO-1").select("code")


#: one query for each kind of field, one for a part of a word, one too short for a gram, one that nothing holds
SOUGHT = (" MO-1", "Brand#1", "0000012", "chin", "-T", "red-", "e", "zzz")


@register(
    f"""WITH {CLUSTERS}, {TAG_MAP}, sought AS (SELECT unnest([{", ".join(f"'{q}'" for q in SOUGHT)}]) AS query), vals AS (
            SELECT code, unnest([code, title, owner, maker, label, series]) AS v FROM items UNION ALL SELECT code, unnest(tags) FROM items
            UNION ALL SELECT code, coalesce(dst, t) FROM (SELECT code, unnest(tags) AS t FROM items) x LEFT JOIN tm ON tm.src = x.t
            UNION ALL SELECT code, team FROM items i JOIN profiles p ON p.name = i.owner UNION ALL SELECT code, alias FROM items i JOIN cl ON cl.canonical = i.owner
            UNION ALL SELECT code, dst FROM (SELECT code, unnest(tags) AS t FROM items) x JOIN tm ON tm.src = x.t)
        SELECT DISTINCT query, code FROM sought JOIN vals ON contains(lower(v), lower(trim(query)))""",
    ("items", "profiles", "edges", "curated", "dictionary"),
)
def search_everywhere(spark: SparkSession, d: str) -> DataFrame:
    tag_map = tags.build_tag_map(view(spark, d, "dictionary"))
    items = tags.translate_aligned(view(spark, d, "items"), "tags", tag_map)
    owners = view(spark, d, "profiles").select(F.col("name").alias("src"), F.col("team").alias("dst"))
    return postings.search_everywhere(items, SOUGHT, owners, _clusters(spark, d), tag_map, store=io.scratch_folder(spark))


@register(
    """SELECT count(*) AS items, min(substr(date, 1, 4)) AS first_year, max(substr(date, 1, 4)) AS last_year, count(*) FILTER (WHERE rating <> 0) AS rated,
              round(avg(rating) FILTER (WHERE rating <> 0), 4) AS mean_rating FROM items""",
    ("items",),
)
def stats_overview(spark: SparkSession, d: str) -> DataFrame:
    return serving.stats_overview(view(spark, d, "items"))


@register("SELECT substr(date, 1, 4) AS year, count(*) AS n, round(100 * count(*) / max(count(*)) OVER (), 4) AS bar FROM items WHERE date IS NOT NULL GROUP BY 1", ("items",))
def items_per_year(spark: SparkSession, d: str) -> DataFrame:
    return serving.items_per_year(view(spark, d, "items"))


@register("SELECT maker AS key, count(*) AS n FROM items GROUP BY maker", ("items",))
def group_by_field(spark: SparkSession, d: str) -> DataFrame:
    return serving.group_by_field(view(spark, d, "items"), F.col("maker"))


@register(
    """SELECT label, code, rating, CAST(rank AS INT) AS rank FROM (SELECT label, code, rating, row_number() OVER (PARTITION BY label ORDER BY rating DESC, code) AS rank FROM items) WHERE rank <= 5""",
    ("items",),
)
def group_topn(spark: SparkSession, d: str) -> DataFrame:
    return ordered.top_per_group(view(spark, d, "items"), ["label"], [F.desc("rating"), F.col("code")], 5).select("label", "code", "rating", "rank")


@register(
    """SELECT owner, count(*) AS items, min(substr(date, 1, 4)) AS first_year, max(substr(date, 1, 4)) AS last_year, count(*) FILTER (WHERE rating <> 0) AS rated,
              round(avg(rating) FILTER (WHERE rating <> 0), 1) AS mean_rating FROM items GROUP BY owner""",
    ("items",),
)
def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    return serving.entity_detail(view(spark, d, "items"))


@register("SELECT code, date FROM items ORDER BY coalesce(date, '') DESC, code LIMIT 60", ("items",))
def latest(spark: SparkSession, d: str) -> DataFrame:
    return serving.latest(view(spark, d, "items")).select("code", "date")


@register("SELECT owner, max(date) AS latest FROM items WHERE owner <> '' GROUP BY owner ORDER BY latest DESC NULLS LAST, owner LIMIT 12", ("items",))
def newest_entities(spark: SparkSession, d: str) -> DataFrame:
    return serving.newest_entities(view(spark, d, "items"))


@register("SELECT owner, count(*) AS n FROM items GROUP BY owner", ("items",))
def items_per_owner(spark: SparkSession, d: str) -> DataFrame:
    return audit.items_per_owner(view(spark, d, "items"))


@register("SELECT CASE WHEN k % 3 = 0 THEN raw ELSE code END || '.json' AS file_name FROM items WHERE k % 3 = 0 AND raw NOT IN (SELECT code FROM items)", ("items",))
def storage_reconcile(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items")
    stored = items.select(F.concat(F.when(F.col("k") % 3 == 0, F.col("raw")).otherwise(F.col("code")), F.lit(".json")).alias("file_name"))
    return audit.reconcile(stored, items)


# a dictionary that knows some names as they are and the others in upper case only
NAME_MAP = "SELECT CASE WHEN team IS NULL THEN upper(name) ELSE name END AS src, coalesce(team, 'none') AS dst FROM profiles"


@register(
    f"""WITH m AS ({NAME_MAP})
        SELECT code, coalesce(a.dst, b.dst) AS team FROM items LEFT JOIN m a ON a.src = owner LEFT JOIN m b ON b.src = upper(owner)""",
    ("items", "profiles"),
)
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = spark.sql(NAME_MAP.replace("profiles", "{profiles}"), profiles=view(spark, d, "profiles"))
    items = view(spark, d, "items").select("code", "owner", F.upper("owner").alias("upper_owner"))
    return names.look_up_name(items, known, "owner", "upper_owner", "team").select("code", "team")


@register(
    """SELECT p.name, CASE WHEN c.name IS NOT NULL THEN c.name ELSE replace(p.name, 'Supplier', 'S') END AS hit
       FROM profiles p LEFT JOIN curated c ON c.name = p.name WHERE c.name IS NOT NULL OR p.team IS NULL""",
    ("profiles", "curated"),
)
def name_probe(spark: SparkSession, d: str) -> DataFrame:
    short = F.replace("name", F.lit("Supplier"), F.lit("S"))
    people = view(spark, d, "profiles")
    directory = view(spark, d, "curated").union(people.where("team IS NULL").select(short))
    spelt = people.select("name", F.array(F.concat("name", F.lit("?")), F.col("name"), short).alias("spellings"))
    return names.probe_candidates(spelt, "spellings", directory)


@register("SELECT i.code, nullif(p.avatar, '') AS avatar FROM items i LEFT JOIN profiles p ON p.name = i.owner AND p.avatar <> ''", ("items", "profiles"))
def attached_values(spark: SparkSession, d: str) -> DataFrame:
    known = view(spark, d, "profiles").select(F.col("name").alias("src"), F.col("avatar").alias("dst"))
    return names.attach_value(view(spark, d, "items"), known, "owner", "avatar").select("code", "avatar")


@register("SELECT code FROM items WHERE owner = 'Supplier#000000003'", ("items",))
def entity_records(spark: SparkSession, d: str) -> DataFrame:
    return serving.records_of(view(spark, d, "items"), "entity", "Supplier#000000003").select("code")


@register("SELECT name FROM profiles WHERE team IS NULL", ("profiles",))
def ungrouped_entities(spark: SparkSession, d: str) -> DataFrame:
    return serving.entities_of_group(view(spark, d, "profiles"), "team", None).select("name")


@register(
    """SELECT "group", code, rank FROM (SELECT nullif(maker, '') AS "group", code,
              CAST(row_number() OVER (PARTITION BY nullif(maker, '') ORDER BY coalesce(date, '') DESC, code) AS INT) AS rank FROM items) WHERE rank <= 3""",
    ("items",),
)
def grouped_records(spark: SparkSession, d: str) -> DataFrame:
    newest = [F.coalesce("date", F.lit("")).desc(), F.col("code")]
    return serving.group_records(view(spark, d, "items"), F.col("maker"), newest, 3).select("group", "code", "rank")


@register("SELECT alias, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS canonicals FROM edges GROUP BY alias", ("edges",))
def alias_inversion(spark: SparkSession, d: str) -> DataFrame:
    return io.invert_aliases(view(spark, d, "edges")).withColumn("canonicals", joined("canonicals"))


@register("SELECT name FROM profiles UNION SELECT name FROM curated UNION SELECT owner FROM items WHERE owner <> ''", ("profiles", "curated", "items"))
def entity_universe(spark: SparkSession, d: str) -> DataFrame:
    owners = view(spark, d, "items").where("owner <> ''").select("owner")
    return ordered.union_keys(view(spark, d, "profiles").select("name"), view(spark, d, "curated"), owners)


@register("SELECT name FROM curated WHERE name NOT IN (SELECT name FROM profiles)", ("profiles", "curated"))
def without_profile(spark: SparkSession, d: str) -> DataFrame:
    return ordered.difference(view(spark, d, "curated"), view(spark, d, "profiles"), ["name"])


@register(
    "SELECT maker, count(*) AS n, greatest(count(*) OVER () - 10, 0) AS omitted FROM items WHERE maker IS NOT NULL GROUP BY maker ORDER BY n DESC, maker LIMIT 10",
    ("items",),
)
def head_of_report(spark: SparkSession, d: str) -> DataFrame:
    makers = view(spark, d, "items").where("maker IS NOT NULL").groupBy("maker").agg(F.count("*").alias("n"))
    return serving.head_and_rest(makers, [F.desc("n"), "maker"], 10)


@register("SELECT coalesce(source, 'none') AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM items GROUP BY 1", ("items",))
def status_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "items").withColumn("source", F.coalesce("source", F.lit("none")))
    return audit.share_of_total(audit.status_counts(rows, "source"))


@register("SELECT * EXCLUDE (r) FROM (SELECT code, source, title, row_number() OVER (PARTITION BY code ORDER BY priority DESC) AS r FROM observations WHERE trim(title) <> '') WHERE r = 1", ("observations",))
def newest_observation(spark: SparkSession, d: str) -> DataFrame:
    return ordered.keep_last(view(spark, d, "observations").where("trim(title) <> ''"), ["code"], ["priority"]).select("code", "source", "title")


@register(f"SELECT count(DISTINCT {RESOLVED}) AS entities, count(*) AS items FROM items", ("items",))
def global_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.global_counts(view(spark, d, "items"))


@register(
    """WITH t AS (SELECT 0 AS ord, 'one' AS site, 'https://one.example.com/' AS head UNION ALL SELECT 1, 'two', 'https://two.example.com/'),
            l AS (SELECT code, 1 AS pos, 'source' AS site, 'https://one.example.com/' || code AS url FROM items WHERE k % 2 = 0
                  UNION ALL SELECT code, 1000 + ord, site, head || code FROM items, t)
       SELECT code, CAST(min(pos) AS INT) AS pos, arg_min(site, pos) AS site, url FROM l GROUP BY code, url""",
    ("items",),
)
def link_union(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items").select("code", F.lit(None).cast("map<string,string>").alias("external_links"), F.lit(None).cast("string").alias("trailer"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("https://one.example.com/"), "code")).alias("source_url"))
    return serving.link_union(items, [("one", "https://one.example.com/{code}"), ("two", "https://two.example.com/{code}")])


_PARSED = r"""s1 AS (SELECT *, CASE WHEN regexp_matches(fn, '^\d{4}-\d{2}-\d{2} ') THEN substr(fn, 1, 10) END AS file_date, regexp_replace(fn, '^\d{4}-\d{2}-\d{2} ', '') AS a FROM files),
    s2 AS (SELECT *, regexp_extract(a, '(\.(?:mp4|jpg))$', 1) AS ext, regexp_replace(a, '\.(mp4|jpg)$', '') AS b FROM s1),
    s3 AS (SELECT *, TRY_CAST(regexp_extract(b, '\.part(\d+)', 1) AS INT) AS part, regexp_replace(b, '\.part\d+', '') AS c FROM s2),
    s4 AS (SELECT *, TRY_CAST(regexp_extract(c, '(?:\s\(|_)(\d+)\)?$', 1) AS INT) AS copy, regexp_replace(c, '(\s\(\d+\)|_\d+)$', '') AS e FROM s3),
    s5 AS (SELECT *, CASE WHEN e LIKE '%\_4K60fps' ESCAPE '\' THEN '[4K][60fps]' WHEN e LIKE '%\_4Ks2' ESCAPE '\' THEN '[4K-S2]' WHEN e LIKE '%[8K]' THEN '[8K]' ELSE '' END AS tags,
                  regexp_replace(e, '(_4K60fps|_4Ks2|\[8K\])$', '') AS f FROM s4),
    s6 AS (SELECT *, regexp_extract(f, '^([A-Z]+)([-_]?)(\d+)', 1) AS letters, regexp_extract(f, '^([A-Z]+)([-_]?)(\d+)', 2) AS dash, regexp_extract(f, '^([A-Z]+)([-_]?)(\d+)', 3) AS digits,
                  trim(regexp_replace(f, '^[A-Z]+[-_]?\d+', '')) AS body FROM s5),
    s7 AS (SELECT *, CASE WHEN letters <> '' THEN letters || '-' END || CASE WHEN dash <> '' THEN digits ELSE CAST(TRY_CAST(digits AS INT) AS VARCHAR) END AS code FROM s6),
    s8 AS (SELECT s7.*, coalesce(CASE WHEN letters <> '' THEN nullif(body, '') END, nullif(i.title, '')) AS title, coalesce(file_date, i.date) AS date FROM s7 LEFT JOIN items i ON i.code = s7.code),
    plan AS (SELECT *, CASE WHEN s8.code IS NULL THEN 'unparsable' WHEN ext = '' THEN 'extension' END AS reason, CASE WHEN s8.code IS NOT NULL AND ext <> '' THEN
        rtrim(trim(regexp_replace(concat_ws(' ', date, code, replace(title, '/', '_')) || tags || coalesce(' (' || copy || ')', '') || coalesce('.part' || part, '') || ext, '\s+', ' ', 'g'))) END AS new FROM s8)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return rename.plan_renames(spread(view(spark, d, "files"), "fid"), view(spark, d, "items"))


@register(f"WITH {_PARSED} SELECT fid, code, part, copy, tags, title, date, new, reason FROM plan", ("items", "files"))
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("fid", "code", "part", "copy", F.array_join("tags", "").alias("tags"), "title", "date", "new", "reason")


@register(f"WITH {_PARSED} SELECT parent, new, count(*) AS n, string_agg(fn, '|' ORDER BY fn) AS files FROM plan WHERE reason IS NULL GROUP BY parent, new HAVING count(*) > 1", ("items", "files"))
def rename_collisions(spark: SparkSession, d: str) -> DataFrame:
    return rename.collisions(_plan(spark, d)).withColumn("files", joined("files"))


@register(
    f"""WITH {_PARSED} SELECT CASE ext WHEN '.jpg' THEN 'cover' WHEN '.mp4' THEN 'video' ELSE 'other' END AS type, count(*) AS files, count(*) FILTER (WHERE reason IS NULL AND title IS NOT NULL AND date IS NOT NULL) AS ok,
        count(*) FILTER (WHERE reason IS NULL AND title IS NULL) AS missing_title, count(*) FILTER (WHERE reason IS NULL AND date IS NULL) AS missing_date, count(reason) AS skipped FROM plan GROUP BY 1""",
    ("items", "files"),
)
def rename_summary(spark: SparkSession, d: str) -> DataFrame:
    return rename.plan_summary(_plan(spark, d))


@register("SELECT fid, regexp_replace(replace(fn, '.jpg', '·red.jpg'), '·red([\\[.]|$)', '\\1') AS fn FROM files", ("files",))
def strip_suffix(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").select("fid", rename.strip_suffix(F.replace("fn", F.lit(".jpg"), F.lit("·red.jpg")), "red").alias("fn"))


@register("SELECT DISTINCT c_custkey AS code, CASE WHEN o.n IS NULL THEN 'untried' WHEN o.hit THEN 'hit' ELSE 'miss' END AS fetch_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) > 300000 AS hit FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    cache = view(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.max("o_totalprice").alias("m")).select("code", F.when(F.col("m") > 300000, F.lit("x")).alias("payload"))
    return index.cache_split(view(spark, d, "customer").select(F.col("c_custkey").alias("code")), cache)


@register(
    """SELECT i.code, coalesce(CASE WHEN i.title <> '' THEN i.owner END, i.owner) AS owner, CASE WHEN i.title <> '' THEN i.title ELSE o.title END AS title,
              CASE WHEN i.title <> '' THEN coalesce(i.source, 'pending') WHEN o.code IS NOT NULL THEN 'gamma' ELSE 'pending' END AS source,
              CASE WHEN i.title <> '' THEN 'store' WHEN o.code IS NOT NULL THEN 'fetched' ELSE 'pending' END AS origin
       FROM items i LEFT JOIN (SELECT * FROM observations WHERE source = 'gamma') o ON o.code = i.code WHERE i.title <> '' OR o.code IS NOT NULL OR i.owner <> ''""",
    ("items", "observations"),
)
def read_through(spark: SparkSession, d: str) -> DataFrame:
    items, seen = view(spark, d, "items"), view(spark, d, "observations").where("source = 'gamma'").withColumn("owner", F.lit(None).cast("string"))
    return index.read_through(items.select("code", "owner"), items.select("code", "title", "owner", "source"), seen.select("code", "title", "owner", "source"))


@register(
    """SELECT page_id, CASE WHEN html IS NULL OR length(html) < 2000 THEN 'short' END AS reject_reason, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS n_links,
              regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host FROM pages"""
)
def page_gates(spark: SparkSession, d: str) -> DataFrame:
    gated = pages.page_gates(view(spark, d, "pages"))
    return gated.select("page_id", "reject_reason", F.size(pages.links(F.col("html"))).cast("long").alias("n_links"), F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("host"))


_BARE = "trim(regexp_replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HEAD, _DOC = (_BARE.format(f"regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1)") for t in ("h1", "title"))


@register(f"SELECT page_id, coalesce(nullif({_HEAD}, ''), nullif(trim(string_split({_DOC}, '|')[1]), '')) AS title FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@register(
    """WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*"([^"]*)"', 1))) AS link FROM pages)
       SELECT page_id, link, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '^(https?:)', 1) || link
              WHEN link = '' THEN url WHEN starts_with(link, '#') THEN regexp_extract(url, '^([^#]*)', 1) || link WHEN starts_with(link, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || link
              WHEN starts_with(link, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || link
              ELSE coalesce(nullif(regexp_extract(url, '^(https?://[^?#]*/)', 1), ''), regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/') || link END AS absolute FROM l"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "pages").select("page_id", "url", F.explode(pages.links(F.col("html"))).alias("link"))
    return rows.select("page_id", "link", pages.absolute_url(F.col("link"), F.col("url")).alias("absolute"))


@register(
    """WITH c AS (SELECT page_id, unnest(x) AS link, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS x FROM pages))
       SELECT link AS code, arg_min(page_id, (page_id, pos)) AS page_id FROM c WHERE link <> '' GROUP BY link"""
)
def page_cards(spark: SparkSession, d: str) -> DataFrame:
    return pages.cards(view(spark, d, "pages"), r'<li><a href="[^"]*">', {"code": r'href="([^"]*)"'}).select("code", "page_id")


@register(
    """SELECT d.lang, count(*) AS docs, count(l.quality) AS labelled, count(*) FILTER (WHERE l.quality = 1) AS good, 100 * count(l.quality) // count(*) AS pct
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang"""
)
def doc_quality_join(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "documents").select("doc_id", "lang").join(view(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.floor(100 * F.count("quality") / F.count("*")).alias("pct"))


@register("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY event_type")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(pages.json_field(F.col("props"), "k").cast("long")).alias("total_k"))


@register(
    f"""WITH f AS (SELECT i.k, {NORMAL.replace('raw', 'i.raw')} AS code, {_fill('i.title', 'o.title')} AS title, coalesce(i.date, o.date) AS date, i.cover, coalesce(nullif(i.owner, ''), 'other') AS owner
                   FROM items i LEFT JOIN (SELECT * FROM observations WHERE source = 'beta') o ON o.code = i.code)
        SELECT owner, count(*) AS n, count(*) FILTER (WHERE title IS NULL OR title = '' OR date IS NULL OR cover = '') AS incomplete, min(code) AS first_code FROM f GROUP BY owner""",
    ("items", "observations"),
)
def curated_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Gaps filled from a second source, codes normalised, completeness flagged, owners ranked."""
    items = view(spark, d, "items").withColumn("owner", index.resolve_owner(view(spark, d, "items").drop("members")))
    # sources know an item by its own code, which a raw spelling may have cut: the fill comes before the normalising
    filled = merge.fill_merge(items, view(spark, d, "observations").where("source = 'beta'"), ["title", "date"], ROLES)
    filled = filled.withColumn("code", text.normalize_id(F.col("raw")))
    flagged = audit.annotate_completeness(filled)
    out = flagged.groupBy("owner").agg(F.count("*").alias("n"), F.count_if("incomplete").alias("incomplete"), F.min("code").alias("first_code"))
    return out.orderBy(F.desc("n"), "owner")


@register(
    """SELECT 'tag' AS kind, count(DISTINCT value) AS "values" FROM (SELECT unnest(tags) AS value FROM items) WHERE value <> ''
       UNION ALL SELECT 'maker', count(DISTINCT value) FROM (SELECT unnest([maker, label]) AS value FROM items) WHERE value <> ''
       UNION ALL SELECT 'series', count(DISTINCT series) FROM items WHERE series <> ''""",
    ("items",),
)
def facet_totals(spark: SparkSession, d: str) -> DataFrame:
    return serving.facet_totals(view(spark, d, "items"), ("tag", "maker", "series"))


@register(
    """WITH v AS (SELECT 'maker' AS kind, unnest([maker, label]) AS value FROM items UNION ALL SELECT 'tag', unnest(tags) FROM items
                 UNION ALL SELECT 'series', series FROM items UNION ALL SELECT 'owner', owner FROM items),
            n AS (SELECT kind, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL),
            r AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS INT) AS place, value, n FROM n)
       SELECT kind, place, value, n FROM r WHERE place <= CASE kind WHEN 'tag' THEN 24 WHEN 'series' THEN 10 ELSE 15 END""",
    ("items",),
)
def facet_overview(spark: SparkSession, d: str) -> DataFrame:
    return serving.overview(view(spark, d, "items"), {"maker": 15, "tag": 24, "series": 10, "owner": 15})


SORTED = {
    "date_desc": "coalesce(date, '') DESC, code", "date_asc": "coalesce(date, ''), code", "rating": "coalesce(rating, 0) DESC, code",
    "duration": "coalesce(duration, 0) DESC, code", "code": "code",
}


@register("\nUNION ALL\n".join(f"(SELECT '{mode}' AS mode, code FROM items ORDER BY {order} LIMIT 60)" for mode, order in SORTED.items()), ("items",))
def sorted_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the catalogue in each of its orders."""
    out = None
    for mode in SORTED:
        one = serving.sort_items(view(spark, d, "items"), mode).limit(60).select(F.lit(mode).alias("mode"), "code")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    r"""WITH t AS (SELECT *, substr(date, 1, 4 + 3 * CAST(k % 3 AS INT)) AS cut FROM items)
        SELECT code, CASE length(cut) WHEN 10 THEN 'day' WHEN 7 THEN 'month' WHEN 4 THEN 'year' END AS precision,
               coalesce(try_cast(regexp_extract(cut, '^(\d{4}-\d{2})', 1) || '-01' AS DATE) >= DATE '1996-06-01' - INTERVAL 720 DAY, false) AS recent,
               coalesce(array_to_string([x FOR x IN tags IF x <> ''], ';'), '') AS tag_text, CAST(substr(CAST(duration AS VARCHAR), 1, 4) AS INT) AS minutes,
               regexp_replace(coalesce(cover, ''), '[\\/:*?"<>|]', '_', 'g') AS file_name,
               repeat('0', greatest(0, 3 - length(CAST(k AS VARCHAR)))) || k AS padded, coalesce(nullif(title, ''), raw, '') AS shown,
               CASE WHEN upper(series) <> regexp_extract(upper(code), '^([A-Z]+)', 1) THEN series END AS own_series,
               CASE WHEN code LIKE 'PROMO%' THEN 'PR' || substr(code, 6) ELSE code END AS rewritten
        FROM t""",
    ("items",),
)
def text_fields(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items")
    cut = F.substring(F.col("date"), F.lit(1), (4 + 3 * (F.col("k") % 3)).cast("int"))
    return items.select(
        "code", text.date_precision(cut).alias("precision"), text.is_recent(cut, F.lit("1996-06-01").cast("date")).alias("recent"), text.stringify(F.col("tags"), True).alias("tag_text"),
        text.duration_minutes(F.concat("duration", F.lit(" min"))).alias("minutes"), text.safe_name(F.col("cover")).alias("file_name"), text.zero_pad(F.col("k"), F.lit(3)).alias("padded"),
        text.display_value(F.col("title"), F.col("raw")).alias("shown"), mapping.clear_prefix(F.col("series"), F.col("code")).alias("own_series"), text.rewrite_prefix(F.col("code"), {"PROMO": "PR"}).alias("rewritten"),
    )


@register(
    """SELECT CASE WHEN fn LIKE '%.jpg' THEN 'cover' WHEN fn LIKE '%.mp4' THEN 'video' ELSE 'other' END AS kind, count(*) AS n FROM files GROUP BY ALL""",
    ("files",),
)
def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").groupBy(text.media_kind(F.regexp_extract("fn", r"(\.[^.]*)$", 1)).alias("kind")).agg(F.count("*").alias("n"))


@register(
    """WITH g AS (SELECT * FROM observations WHERE source = 'gamma')
       SELECT i.code, g.title, g.date, coalesce(i.owner, g.maker) AS owner, coalesce(CASE WHEN length(g.title) > 20 THEN 'https://g.example.com/' || i.code END, i.cover) AS cover,
              CASE WHEN g.title IS NOT NULL THEN 'gamma' ELSE 'pending' END AS source FROM items i LEFT JOIN g ON g.code = i.code""",
    ("items", "observations"),
)
def observed_record(spark: SparkSession, d: str) -> DataFrame:
    cover = F.when(F.length("title") > 20, F.concat(F.lit("https://g.example.com/"), "code"))
    parsed = view(spark, d, "observations").where("source = 'gamma'").select("code", "title", "date", F.col("maker").alias("owner"), cover.alias("cover"))
    return merge.observed_record(view(spark, d, "items"), parsed, "gamma")


@register(
    """WITH b AS (SELECT *, coalesce(nullif(trim(zh_cn), ''), nullif(trim(zh_tw), ''), nullif(trim(translate), '')) AS base FROM dictionary),
            c AS (SELECT *, coalesce(base IS NOT NULL AND translate(base, 'ae', 'xy') <> coalesce(zh_cn, ''), false) AS fixed FROM b)
       SELECT source, ja, CASE WHEN fixed THEN translate(base, 'ae', 'xy') ELSE zh_cn END AS zh_cn, fixed FROM c""",
    ("dictionary",),
)
def dictionary_fixed(spark: SparkSession, d: str) -> DataFrame:
    return tags.fix_dictionary(view(spark, d, "dictionary"), ("ae", "xy")).select("source", "ja", "zh_cn", "fixed")


@register(
    """WITH g AS (SELECT * FROM observations WHERE source = 'gamma'),
            p AS (SELECT g.maker AS src, i.maker AS dst, count(*) AS n FROM items i JOIN g ON g.code = i.code WHERE i.maker <> '' AND g.maker <> '' GROUP BY ALL),
            r AS (SELECT *, sum(n) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS place FROM p),
            m AS (SELECT src, dst FROM r WHERE place = 1 AND n >= 0.8 * total),
            j AS (SELECT i.code, i.series, i.date, i.maker, g.code AS hit, g.date AS seen_date, g.maker AS seen_maker, m.dst, upper(i.series) = regexp_extract(upper(i.code), '^([A-Z]+)', 1) AS bare
                  FROM items i LEFT JOIN g ON g.code = i.code LEFT JOIN m ON m.src = g.maker)
       SELECT code, CASE WHEN NOT bare THEN series END AS series, coalesce(date, seen_date) AS date, coalesce(maker, dst) AS maker,
              concat_ws('|', CASE WHEN hit IS NULL THEN 'no_hit' END, CASE WHEN bare THEN 'clear_series_prefix' END, CASE WHEN date IS NULL AND seen_date IS NOT NULL THEN 'fill_date' END,
                        CASE WHEN maker IS NULL AND dst IS NOT NULL THEN 'fill_maker' WHEN maker IS NULL AND seen_maker IS NOT NULL THEN 'unmapped_maker' END) AS events
       FROM j""",
    ("items", "observations"),
)
def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Series that are only the code's letters cleared, dates and makers filled from a source that names makers in its own way."""
    items, seen = view(spark, d, "items").select("code", "series", "date", "maker"), view(spark, d, "observations").where("source = 'gamma'")
    learned = mapping.learn_mapping(mapping.labelled_pairs(items, seen, "maker", "maker"))
    out = mapping.backfill(items, seen.select("code", "date", "maker"), {"maker": ("maker", learned)}, ["date"])
    return out.withColumn("events", joined("events"))


@register(
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1) AS t FROM pages), u AS (
           SELECT page_id, i, replace(t[i], '&amp;', '&') AS name, replace(t[i + 1], '&amp;', '&') AS mark FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM l) x)
       SELECT page_id, string_agg(name, '|' ORDER BY i) AS names FROM (SELECT page_id, name, min(i) AS i FROM u WHERE name <> '' AND NOT contains(coalesce(mark, ''), 'e') GROUP BY ALL) y GROUP BY page_id"""
)
def unmarked_names(spark: SparkSession, d: str) -> DataFrame:
    return tokens.unmarked(view(spark, d, "pages"), "marked", "e", tag="li").select("page_id", joined("names").alias("names"))


@register()
def page_outline(spark: SparkSession, d: str) -> DataFrame:
    """Each page's elements by tag; tests hold it against another reading of the pages."""
    rows = tokens.with_next(tokens.elements(view(spark, d, "pages")))
    alike = F.count_if(F.coalesce(F.col("next.tag") == F.col("tag"), F.lit(False)))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), alike.alias("followed"), F.sum(F.length("text")).alias("letters"))


@register(
    """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS owner, o_orderkey % 8 = 0 AS bare FROM orders WHERE o_orderkey % 41 <> 0),
            n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS owner, o_orderkey % 10 = 0 AS titled FROM orders WHERE o_orderkey % 43 <> 0)
       SELECT CAST(coalesce(o.k, n.k) AS VARCHAR) AS code, CASE WHEN o.k IS NULL OR n.k IS NULL THEN 'error' WHEN o.bare THEN 'cast_reverted'
              WHEN o.owner IS NOT DISTINCT FROM coalesce(o.owner, n.owner) AND NOT titled THEN 'noise' WHEN o.owner IS NOT NULL AND o.owner IS DISTINCT FROM n.owner THEN 'attrib_restored' ELSE 'kept' END AS class
       FROM o FULL JOIN n ON n.k = o.k WHERE o.k IS NULL OR n.k IS NULL OR o.owner IS DISTINCT FROM n.owner OR o.bare OR titled"""
)
def snapshot_sweep_digests(spark: SparkSession, d: str) -> DataFrame:
    return digests.sweep(*_snapshots(spark, d), ROLES).select("code", "class")


#: phrases that overlap: the longest at each place counts, from left to right
PHRASES = (("ed", "1"), ("red", "2"), ("d s", "3"), ("d st", "4"), ("steel", "5"), ("teel", "6"), ("el", "7"), ("green b", "8"), ("n bolt", "9"))
LETTERS = (("e", "E"), ("ed", "no"), ("t", "T"))
_ENTRIES = ", ".join(f"('{a}', '{b}')" for a, b in (*PHRASES, *(x for x in LETTERS if len(x[0]) == 1)))


@register(
    f"""WITH RECURSIVE entries(src, dst) AS (VALUES {_ENTRIES}), places AS (SELECT p_partkey AS k, p_name AS t, unnest(range(1, length(p_name) + 1)) AS pos FROM part), longest AS (
            SELECT k, pos, max(length(src)) AS len, arg_max(dst, length(src)) AS dst FROM places JOIN entries ON substr(t, pos, length(src)) = src GROUP BY k, pos
        ), walk AS (
            SELECT p_partkey AS k, p_name AS t, CAST(1 AS BIGINT) AS pos, '' AS done FROM part
            UNION ALL SELECT w.k, w.t, w.pos + coalesce(l.len, 1), w.done || coalesce(l.dst, substr(w.t, w.pos, 1)) FROM walk w LEFT JOIN longest l ON l.k = w.k AND l.pos = w.pos WHERE w.pos <= length(w.t)
        ) SELECT k, done AS converted FROM walk WHERE pos > length(t)"""
)
def phrase_conversion(spark: SparkSession, d: str) -> DataFrame:
    schema = "src string, dst string"
    convert = phrases.converter(spark.createDataFrame(PHRASES, schema), spark.createDataFrame(LETTERS, schema))
    return view(spark, d, "part").select(F.col("p_partkey").alias("k"), convert("p_name").alias("converted"))


#: labels of fields, of which some are parts of a page's labels and some hold them
SYNONYMS = (("the", "article"), ("that", "article"), ("und", "joint"), ("nicht wahr", "denial"), ("ing", "form"), ("für alle", "aim"), ("attionals", "long"))


@register(
    f"""WITH s(name, field) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS)}), pairs AS (
            SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) AS l, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) AS v, unnest(range(1000)) AS pos FROM pages
        ), long AS (SELECT page_id, pos, lower(l) AS label, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS value FROM pairs WHERE l IS NOT NULL), near AS (
            SELECT page_id, field, value, pos, CASE WHEN label = name THEN 0 ELSE 1 END AS far FROM long JOIN s ON contains(label, name) OR contains(name, label) WHERE label <> '' AND value <> ''
        ) SELECT page_id, field, arg_min(value, (far, pos, value)) AS value FROM near GROUP BY page_id, field"""
)
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame(SYNONYMS, "label string, field string")
    return pages.labelled_rows(view(spark, d, "pages"), names, r'(?is)<a href="/([^"]*)">([^<]*)</a>', contains=True)
