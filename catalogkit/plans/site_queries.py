"""Queries over pages of a site that is made from the given tables, beside oracles that take each field from the
columns the pages were made of, not from the pages; and the small operators that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.functions import text
from catalogkit.operators import audit, index, mapping, merge, names, ordered, rename, select, serving
from catalogkit.plans.adapters import spread, view
from catalogkit.plans.queries import _PARSED, NORMAL, _plan, joined, register
from catalogkit.sources import pages


def site(spark: SparkSession, d: str) -> DataFrame:
    """A page for each part, with fields in every form that the rules read."""
    p = spread(view(spark, d, "part"), "p_partkey")
    k, name, brand, size = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_size")
    code = F.concat(F.col("p_type"), F.lit("-"), k)
    odd = F.col("p_partkey") % 2 == 1
    quote = lambda a, b: F.when(odd, a).otherwise(b)
    html = F.concat(
        F.lit("<html><head><title>"), code, F.lit(" "), name, F.lit(" - Site | Shop</title>"),
        quote(F.concat(F.lit('<meta property="og:image" content="https://i.example.com/'), k, F.lit('.jpg">')), F.concat(F.lit("<meta content='https://i.example.com/"), k, F.lit(".jpg' property='og:image'>"))),
        F.lit("</head><body>"), quote(F.concat(F.lit("<h1> "), name, F.lit(" （"), F.lower(brand), F.lit(" / "), F.upper(brand), F.lit("） </h1>")), F.concat(F.lit("<h1>"), name, F.lit("</h1>"))),
        F.lit("<dl><dt>Maker:</dt><dd><b>"), brand, F.lit("</b> &c</dd><dt>Size</dt><dd>T"), (size + 100).cast("string"), F.lit(" / B"), (size + 50).cast("string"), F.lit("</dd></dl>"),
        F.lit('<img class="x" data-src="/c/'), k, F.lit('.png" src="blank.gif">'), F.lit('<script>{"actor":[{"name":"A \\"'), brand, F.lit('\\""},{"name":"B"},{"name":"B"}],"director":{"name":"D, '), k, F.lit('"},"genre":"'),
        F.replace(name, F.lit(" "), F.lit(", ")), F.lit('","rank":'), size.cast("string"), F.lit("}</script>"),
        F.lit("<p>"), F.when(F.col("p_partkey") % 3 == 0, F.concat((size * 3).cast("string"), F.lit(" min"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("PT1H"), size.cast("string"), F.lit("M"))).otherwise(F.concat(F.lit("duration about "), (size * 20).cast("string"))), F.lit("</p>"),
        F.lit("<p>1998年デビュー, 20"), F.lpad((size % 100).cast("string"), 2, "0"), F.lit(" comeback; on 2001."), (size % 12 + 1).cast("string"), F.lit("."), (size % 28 + 1).cast("string"), F.lit("</p><i>"),
        name, F.lit(" (note), "), brand, F.lit("（x）;"), name, F.lit("</i></body></html>"),
    )
    return p.select(F.col("p_partkey").alias("page_id"), html.alias("html"), code.alias("code"))


@register(
    """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 1 THEN p_name || ' （' || lower(p_brand) || ' / ' || upper(p_brand) || '）' ELSE p_name END AS title, p_name AS cleaned,
              'https://i.example.com/' || p_partkey || '.jpg' AS image, p_brand || ' &c' AS maker, CAST(p_size AS VARCHAR) AS rank, 'A "' || p_brand || '"|B' AS actors, 'D, ' || p_partkey AS director,
              replace(p_name, ' ', '|') AS genres, '/c/' || p_partkey || '.png' AS picture FROM part"""
)
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    title = F.regexp_extract(html, "<title>(.*?)</title>", 1)
    return site(spark, d).select(
        "page_id", pages.page_title(html).alias("title"), pages.clean_title(title, [" - Site"], F.col("code")).alias("cleaned"), pages.og_image(html).alias("image"),
        pages.definition(html, ["Studio", "Maker"]).alias("maker"), pages.json_field(html, "rank").alias("rank"), joined(pages.json_names(html, "actor")).alias("actors"),
        joined(pages.json_names(html, "director")).alias("director"), joined(pages.json_list(html, "keywords", "genre")).alias("genres"), pages.lazy_image(html).alias("picture"),
    )


@register(
    """SELECT p_partkey AS page_id, CASE WHEN m BETWEEN 5 AND 600 THEN m END AS minutes, p_name AS name, CASE WHEN p_partkey % 2 = 1 THEN lower(p_brand) END AS reading, CASE WHEN p_partkey % 2 = 1 THEN upper(p_brand) END AS roman,
              CASE WHEN p_size + 100 BETWEEN 10 AND 999 THEN p_size + 100 END AS t, CASE WHEN p_size + 50 BETWEEN 10 AND 999 THEN p_size + 50 END AS b, CAST(NULL AS INT) AS w,
              1998 AS debut, 2000 + p_size % 100 AS comeback, '2001-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS date,
              CASE WHEN p_name = p_brand THEN p_name ELSE p_name || '|' || p_brand END AS names
       FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_size * 3 WHEN 1 THEN 60 + p_size ELSE p_size * 20 END AS m FROM part) x"""
)
def profile_fields(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    notes = F.regexp_extract(html, "<i>(.*?)</i>", 1)
    told = F.regexp_extract(html, "<p>([^<]*comeback[^<]*)</p>", 1)
    rows = site(spark, d).select("page_id", "html", pages.profile_header(html).alias("h"), pages.sizes(pages.definition(html, ["Size"])).alias("s"), notes.alias("notes"), told.alias("told"))
    return rows.select(
        "page_id", pages.duration(html).alias("minutes"), "h.name", "h.reading", "h.roman", "s.t", "s.b", "s.w", text.debut_year(F.col("told")).alias("debut"),
        text.comeback_year(F.col("told")).alias("comeback"), pages.iso_date(F.regexp_extract("told", "on (.*)", 1)).alias("date"), joined(pages.names_without_notes(F.col("notes"))).alias("names"),
    )


@register(
    """SELECT 'P-' || p_partkey AS code, p_name AS title, 'seen ' || CASE WHEN p_partkey % 3 = 0 THEN 'p-' || p_partkey ELSE 'nothing' END || ' on 1999/' || (p_size % 12 + 1) || '/7' AS snippet,
              '1999-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-07' AS date FROM part WHERE p_partkey % 3 = 0"""
)
def snippets_accepted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    said = F.concat(F.lit("seen "), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("p-"), k)).otherwise("nothing"), F.lit(" on 1999/"), (F.col("p_size") % 12 + 1).cast("string"), F.lit("/7"))
    return pages.accept_snippets(view(spark, d, "part").select(F.concat(F.lit("P-"), k).alias("code"), F.col("p_name").alias("title"), said.alias("snippet")))


_NAMED = "CASE p_partkey % 5 WHEN 0 THEN p_name || '（' || p_brand || '）' WHEN 1 THEN ' ' || p_name || ' (' || p_brand || ') x' WHEN 2 THEN '漢々' || p_name WHEN 3 THEN 'カナ・' || p_name ELSE '・ヽ漢' || p_type || '_0' || p_partkey END"


@register(
    f"""SELECT p_partkey AS k, trim(split_part(split_part(v, '（', 1), '(', 1)) AS name, p_partkey % 5 = 2 AS chinese, p_partkey % 5 IN (3, 4) AS kana, p_partkey % 5 = 3 AS real_kana,
               CASE WHEN regexp_matches(v, '^[A-Za-z]') THEN regexp_replace(translate(upper(trim(v)), ' _.', '---'), '^([A-Z]+)([0-9]+)$', '\\1-\\2') ELSE trim(split_part(split_part(v, '（', 1), '(', 1)) END AS either,
               CASE WHEN p_partkey % 5 = 2 THEN v || '|漢漢' || p_name || '|字字' || p_name ELSE v || CASE WHEN translate(v, '漢', '字') <> v THEN '|' || translate(v, '漢', '字') ELSE '' END END AS spellings
        FROM (SELECT *, {_NAMED} AS v FROM part) x"""
)
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "part").withColumn("v", F.expr(_NAMED))
    v = F.col("v")
    return rows.select(
        F.col("p_partkey").alias("k"), text.normalize_name(v).alias("name"), text.is_chinese(v).alias("chinese"), text.has_kana(v).alias("kana"), text.has_kana(v, ignore_marks=True).alias("real_kana"),
        text.normalize(v).alias("either"), joined(text.name_candidates(v, [("漢", "字")])).alias("spellings"),
    )


@register(
    """SELECT code, CASE WHEN cover = '' THEN '' ELSE regexp_replace(regexp_replace(cover, '^https://img', 'https://cdn'), 'xpl[.]jpg$', 'xps.jpg') END AS thumb,
              CASE WHEN title LIKE '%red%' THEN 'warm' WHEN title LIKE '%steel%' THEN 'cold' END AS status, replace(replace(replace('<' || title || '> & "' || label || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS half,
              coalesce(TRY_CAST(date AS DOUBLE), TRY_CAST(rating AS DOUBLE), -1) AS number, coalesce(nullif(cover, ''), nullif(title, '')) AS poster, coalesce(nullif(title, ''), code, '') AS shown FROM items""",
    ("items",),
)
def field_forms(spark: SparkSession, d: str) -> DataFrame:
    rows, c = view(spark, d, "items"), F.col
    escaped = text.escape_html(F.concat(F.lit("<"), c("title"), F.lit('> & "'), c("label"), F.lit('"')))
    return rows.select(
        "code", text.rewrite_url(c("cover"), [("^https://img", "https://cdn"), (r"xpl\.jpg\z", "xps.jpg")]).alias("thumb"), text.status_from_text(c("title"), [("red", "warm"), ("steel", "cold")]).alias("status"),
        F.replace(escaped, F.lit("&quot;"), F.lit('"')).alias("half"), F.coalesce(text.number_or(c("rating").cast("string"), -1), F.lit(-1.0)).alias("number"), text.first_filled(c("cover"), c("title")).alias("poster"),
        text.display_value(c("title"), c("code")).alias("shown"),
    )


@register(
    """SELECT 'item_without_code' AS kind, owner AS key FROM items WHERE k % 20 = 0 UNION ALL SELECT 'entity_without_name', NULL FROM profiles WHERE avatar = ''""",
    ("items", "profiles"),
)
def index_faults(spark: SparkSession, d: str) -> DataFrame:
    people = view(spark, d, "profiles").withColumn("name", F.when(F.col("avatar") != "", F.col("name")))
    return audit.validate_index(people, view(spark, d, "items").withColumn("code", F.when(F.col("k") % 20 != 0, F.col("code"))))


@register(
    """SELECT upper(code) AS code, field, present, preview, CASE WHEN present THEN 'ok' WHEN field = 'rating' THEN 'gap' ELSE 'missing' END AS verdict FROM (
           SELECT code, 'title' AS field, coalesce(title, '') <> '' AS present, substr(title, 1, 5) AS preview FROM items UNION ALL
           SELECT code, 'date', coalesce(date, '') <> '', substr(date, 1, 5) FROM items UNION ALL SELECT code, 'rating', coalesce(rating, 0) <> 0, substr(CAST(rating AS VARCHAR), 1, 5) FROM items) x""",
    ("items",),
)
def field_reports(spark: SparkSession, d: str) -> DataFrame:
    return audit.field_reports(view(spark, d, "items"), ["title", "date", "rating"], cut=5)


@register(
    """SELECT name, team, avatar FROM profiles WHERE team IS NULL AND avatar = ''""",
    ("profiles",),
)
def empty_profiles(spark: SparkSession, d: str) -> DataFrame:
    return select.with_none_of(view(spark, d, "profiles"), ["team", "avatar"]).select("name", "team", "avatar")


@register("SELECT code, source, priority, title, CAST(NULL AS VARCHAR) AS maker, CAST(NULL AS VARCHAR) AS date FROM observations WHERE title NOT IN ('  ') AND title IS NOT NULL", ("observations",))
def whitelisted(spark: SparkSession, d: str) -> DataFrame:
    return select.without_placeholders(select.only_fields(view(spark, d, "observations"), ["title"]), "title", ["  "])


@register("SELECT code, title, owner FROM items WHERE code = (SELECT max(p_type || '-' || p_partkey) FROM part WHERE p_partkey = 7)", ("items",))
def item_lookup(spark: SparkSession, d: str) -> DataFrame:
    code = view(spark, d, "part").where("p_partkey = 7").agg(F.max(F.concat("p_type", F.lit("-"), F.col("p_partkey").cast("string"))).alias("c")).first().c
    return serving.lookup(view(spark, d, "items"), code).select("code", "title", "owner")


@register(
    """SELECT * FROM (SELECT 'title' AS field, count(*) FILTER (WHERE coalesce(title, '') <> '') AS present, count(*) AS total, 100 * count(*) FILTER (WHERE coalesce(title, '') <> '') // count(*) AS pct FROM items
       UNION ALL SELECT 'maker', count(maker), count(*), 100 * count(maker) // count(*) FROM items) x WHERE pct < 82""",
    ("items",),
)
def low_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.low_coverage(audit.field_coverage(view(spark, d, "items"), ("title", "maker")), 82)


@register("SELECT substr(date, 1, 4) AS key, count(*) AS n FROM items GROUP BY 1", ("items",))
def groups_by_year(spark: SparkSession, d: str) -> DataFrame:
    return serving.group_by_field(view(spark, d, "items"), F.substring("date", 1, 4), by_key=True)


@register("SELECT code, source FROM items WHERE date IS NULL ORDER BY code LIMIT 25", ("items",))
def first_targets(spark: SparkSession, d: str) -> DataFrame:
    return select.select_targets(view(spark, d, "items"), missing="date", limit=25).select("code", "source")


@register("SELECT i.code, i.title FROM items i JOIN (SELECT DISTINCT upper(trim(c)) AS c FROM (SELECT ' ' || lower(code) || ' ' AS c FROM items WHERE k % 9 = 0) x) w ON w.c = upper(i.code)", ("items",))
def listed_targets(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items")
    codes = items.where("k % 9 = 0").select(F.concat(F.lit(" "), F.lower("code"), F.lit(" ")).alias("code"))
    return select.select_targets(items, codes=codes.union(codes)).select("code", "title")


@register("SELECT code, array_to_string(tags[1:2], '|') AS head FROM items", ("items",))
def tag_heads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").select("code", joined(ordered.prefix(F.col("tags"), 2)).alias("head"))


@register(
    """WITH g AS (SELECT coalesce(nullif(owner, ''), nullif(members[1], ''), 'other') AS owner, count(DISTINCT code) AS n FROM items GROUP BY 1)
       SELECT g.owner, coalesce(p.name, g.owner) AS name, n AS work_count, avatar FROM g LEFT JOIN profiles p ON p.name = g.owner""",
    ("items", "profiles"),
)
def profiled_groups(spark: SparkSession, d: str) -> DataFrame:
    people = view(spark, d, "profiles").select("name", "avatar")
    groups = index.group_index(view(spark, d, "items").withColumnRenamed("members", "cast")).select("owner", "work_count").distinct()
    return index.attach_profiles(groups, people.union(people)).select("owner", "name", "work_count", "avatar")


@register(
    """SELECT code, arg_min(url, pos) AS url, arg_min(kind, pos) AS kind FROM (
           SELECT p_type || '-' || p_partkey AS code, n AS pos, 'u/' || p_partkey || '/' || n AS url, 'k' || n AS kind FROM part, range(3) r(n)) c
       WHERE url IN (SELECT 'u/' || p_partkey || '/' || (p_size % 4) FROM part UNION SELECT 'u/' || p_partkey || '/2' FROM part WHERE p_size % 2 = 0) GROUP BY code"""
)
def first_available(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    tries = p.select(F.concat("p_type", F.lit("-"), k).alias("code"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    tries = tries.select("code", "pos", F.concat(F.lit("u/"), "k", F.lit("/"), F.col("pos").cast("string")).alias("url"), F.concat(F.lit("k"), F.col("pos").cast("string")).alias("kind"))
    there = p.select(F.concat(F.lit("u/"), k, F.lit("/"), (F.col("p_size") % 4).cast("string")).alias("url")).union(p.where("p_size % 2 = 0").select(F.concat(F.lit("u/"), k, F.lit("/2")).alias("url")))
    return mapping.first_available(tries, there)


@register(
    """SELECT code, min(target) AS target FROM (SELECT 'AB-' || p_partkey AS code, 'AB_' || (p_partkey + n % 2) AS found, 't' || (n % (1 + p_partkey % 2)) AS target FROM part, range(3) r(n)) h
       WHERE upper(code) = regexp_replace(upper(found), '_', '-') GROUP BY code HAVING count(DISTINCT target) = 1"""
)
def exact_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = view(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    k = F.col("p_partkey")
    return names.pick_exact(hits.select(F.concat(F.lit("AB-"), k.cast("string")).alias("code"), F.concat(F.lit("AB_"), (k + F.col("n") % 2).cast("string")).alias("found_code"), F.concat(F.lit("t"), (F.col("n") % (1 + k % 2)).cast("string")).alias("target")))


@register(
    """SELECT name, coalesce(nullif(avatar, ''), 'https://two.example.com/' || name) AS avatar, CASE WHEN length(name) % 2 = 0 THEN '160' ELSE NULL END AS height, 'A-type' AS blood_type,
              concat_ws('|', CASE WHEN length(name) % 2 = 0 THEN 'height' END, 'blood_type', CASE WHEN avatar = '' THEN 'avatar' END) AS changed FROM profiles""",
    ("profiles",),
)
def second_source(spark: SparkSession, d: str) -> DataFrame:
    """Profiles filled from a second source's fields, in the order of its list."""
    own = view(spark, d, "profiles").select("name", "avatar", F.lit(None).cast("string").alias("height"), F.lit("").alias("blood_type"))
    told = own.select("name", F.when(F.length("name") % 2 == 0, "160").alias("height"), F.lit("A-type").alias("blood_type"), F.concat(F.lit("https://two.example.com/"), "name").alias("photo"))
    out = merge.profile_fill(own, told.union(told), [f for f in merge.SECOND_SOURCE if f in told.columns], aliases=None)
    return out.select("name", "avatar", "height", "blood_type", joined("changed_keys").alias("changed"))


@register(
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE k % 2 = 0) AS even, count(*) FILTER (WHERE title IS NULL OR title = '') AS title, count(*) FILTER (WHERE date IS NULL) AS date, 0 AS owner, count(*) FILTER (WHERE {NORMAL} <> code) AS moved FROM items""",
    ("items",),
)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run, gathered while its result is written (to nowhere here)."""
    rows = view(spark, d, "items")
    rows = rows.withColumn("even", F.col("k") % 2 == 0).withColumn("moved", text.normalize_id(F.col("raw")) != F.col("code"))
    gaps = audit.annotate_completeness(rows, ["title", "date"])
    got = audit.counted(gaps, lambda df: df.write.format("noop").mode("overwrite").save(), ["even", "moved"], "missing_fields", ["title", "date", "owner"])
    return spark.createDataFrame([{n.removeprefix("field:"): v for n, v in got.items()}], "rows long, even long, moved long, title long, date long, owner long")


@register(f"WITH {_PARSED} SELECT parent, fid, fn, new FROM plan WHERE reason IS NULL AND new <> fn", ("items", "files"))
def renamed_files(spark: SparkSession, d: str) -> DataFrame:
    return rename.changed_names(_plan(spark, d))
