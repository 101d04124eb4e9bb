"""Label attributes, boxes, files and client lines: the scalar operators, run over whole tables made from the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.functions import geometry as G
from lakefold.functions import text as T
from lakefold.operators import catalog, client, entity, media, policy, similarity
from lakefold.plans.book import Book, Tables
from lakefold.sources import tables as files

BOOK = Book()
#: Words that the texts below are made of, by number; the same in both languages.
SWEET = ("", " polusladkoe", " ekstra-bryut", " suhoe", " bryut", " polusuhoe", " sladkoe")
LABELS = ("вино красное, основан в 1901, урожай {y}, алк. 12,5 % об.", "Белое вино {y}; since 1890 - {y}; 13.0% vol 13 %", "розовое 4% {y} и 2011", "no year here 45 % and 12 %", "ESTD 1999 {y} оранжевое 11%", "Полусладкое игристое {y}", "экстра брют", "сухое вино и брют {y}", "полусухие вина")
WRITTEN = ("Вин0 cухoe", "2o21 гoд", "wine 2021", "мockва o5", "plain words", "хлеб и 0вощи", "")
GRAPES = ("red", "red ring", "ring", "small", "blue widget", "widget")


def _pick(options: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def _sql_pick(options: tuple[str, ...], number: str) -> str:
    return f"([{', '.join(repr(o) for o in options)}])[{number} % {len(options)} + 1]"


YEAR_SQL = "nullif(regexp_extract({0}, '(^|[^0-9])((?:19|20)[0-9][0-9])([^0-9]|$)', 2), '')"


@BOOK.add(f"""WITH x AS (SELECT p_partkey, p_name || ' ' || (1890 + p_partkey % 140) || {_sql_pick(SWEET, "p_size")} || '-' || (p_partkey % 300) AS t FROM part),
s AS (SELECT *, regexp_extract(t, '-([0-9][0-9][0-9]?)$', 1) AS d FROM x), v AS (SELECT *, CASE WHEN length(d) = 2 THEN d::DOUBLE WHEN length(d) = 3 THEN d::DOUBLE / 10 END AS a FROM s)
SELECT p_partkey, {YEAR_SQL.format("t")} AS year, CASE WHEN contains(t, 'polusladkoe') THEN 'polusladkoe' WHEN contains(t, 'polusuhoe') THEN 'polusuhoe' WHEN contains(t, 'sladkoe') THEN 'sladkoe' WHEN contains(t, 'suhoe') THEN 'suhoe'
  WHEN contains(t, 'ekstra-bryut') THEN 'ekstra-bryut' WHEN contains(t, 'bryut') THEN 'bryut' END AS sweetness, CASE WHEN a BETWEEN 5 AND 25 THEN a END AS strength FROM v""")
def slug_attributes(t: Tables) -> DataFrame:
    """Year, sweetness and strength of a slug."""
    slug = F.concat(F.col("p_name"), F.lit(" "), (1890 + F.col("p_partkey") % 140).cast("string"), _pick(SWEET, F.col("p_size")), F.lit("-"), (F.col("p_partkey") % 300).cast("string"))
    return t.part.select("p_partkey", T.year(slug).alias("year"), T.sweetness_code(slug).alias("sweetness"), T.slug_strength(slug).alias("strength"))


# The SQL states what each of the nine labels has, with y the row's year: a foundation year does not count, and of several
# years or strengths there is no one.
_Y = "1900 + p_partkey % 125"


@BOOK.add(f"""WITH x AS (SELECT p_partkey, p_size % 9 AS k, CAST({_Y} AS VARCHAR) AS y FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN CASE WHEN y = '2011' THEN y END WHEN 4 THEN y WHEN 5 THEN y WHEN 7 THEN y END AS year,
  CASE k WHEN 0 THEN 12.5 WHEN 1 THEN 13.0 WHEN 3 THEN 12.0 WHEN 4 THEN 11.0 END::DOUBLE AS strength,
  CASE k WHEN 0 THEN 'Красное' WHEN 1 THEN 'Белое' WHEN 2 THEN 'Розовое' WHEN 4 THEN 'Оранжевое' END AS colour,
  CASE k WHEN 5 THEN 'polusladkoe' WHEN 6 THEN 'ekstra-bryut' WHEN 7 THEN 'bryut' WHEN 8 THEN 'polusuhoe' END AS sweetness FROM x""")
def label_attributes(t: Tables) -> DataFrame:
    """The attributes that a label states once."""
    label = T.canonical(F.replace(_pick(LABELS, F.col("p_size")), F.lit("{y}"), (1900 + F.col("p_partkey") % 125).cast("string")), T.native_fold)
    return t.part.select("p_partkey", T.label_year(label).alias("year"), T.label_strength(label).alias("strength"), T.label_colour(label).alias("colour"), T.sweetness_word(label).alias("sweetness"))


@BOOK.add(f"""SELECT p_partkey, {_sql_pick(("вино сухое", "2021 год", "wine 2021", "москва 05", "plain words", "хлеб и овощи", ""), "p_partkey")} AS repaired FROM part""")
def repaired_labels(t: Tables) -> DataFrame:
    """Look-alike letters and zeros, word by word."""
    return t.part.select("p_partkey", T.repair_scripts(_pick(WRITTEN, F.col("p_partkey")), T.native_fold).alias("repaired"))


@BOOK.add(f"""WITH v(term) AS (VALUES {', '.join(f"('{g}')" for g in GRAPES)}), h AS (SELECT p_partkey, term FROM part JOIN v ON contains(' ' || p_name || ' ', ' ' || term || ' ')),
k AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.p_partkey = a.p_partkey AND b.term <> a.term AND contains(b.term, a.term)))
SELECT p_partkey, coalesce(list(term ORDER BY -length(term), term) FILTER (term IS NOT NULL), []) AS hits FROM part LEFT JOIN k USING (p_partkey) GROUP BY p_partkey""")
def vocabulary_hits(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.longest_hits(F.col("p_name"), list(GRAPES)).alias("hits"))


@BOOK.add("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lead(p_name, 1, p_name) OVER (ORDER BY p_partkey), ' ') AS b FROM part), v AS (SELECT list(DISTINCT x ORDER BY x) AS words FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part)),
c AS (SELECT p_partkey, list_aggregate(list_transform(a, lambda x: chr(1000 + list_position(words, x)::INT)), 'string_agg', '') AS ca, list_aggregate(list_transform(b, lambda x: chr(1000 + list_position(words, x)::INT)), 'string_agg', '') AS cb, list_distinct(a) AS sa, list_distinct(b) AS sb FROM w, v)
SELECT p_partkey, levenshtein(ca, cb)::INT AS edits, round(2.0 * len(list_intersect(sa, sb)) / (len(sa) + len(sb)), 9)::DOUBLE AS f1 FROM c""")
def word_distances(t: Tables) -> DataFrame:
    """Edit distance in words, and token F1, of each name and the next one. The next row is met by its key."""
    names = t.part.select("p_partkey", F.split("p_name", " ").alias("a"))
    following = names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = names.join(following, "p_partkey", "left").withColumn("b", F.coalesce("b", "a"))
    return both.select("p_partkey", T.word_edit_distance(F.col("a"), F.col("b")).cast("int").alias("edits"), F.round(T.token_f1(F.array_distinct("a"), F.array_distinct("b")), 9).alias("f1"))


@BOOK.add(f"""SELECT p_partkey, lower(p_name) AS name_key, lower(p_brand) AS producer_key, '' AS grape_key, {YEAR_SQL.replace("nullif(", "(").replace(", '')", ")").format("p_name")} AS year, p_type AS category_key,
CASE WHEN p_size % 2 = 0 THEN 'suhoe' ELSE '' END AS sweetness FROM part""")
def structured_items(t: Tables) -> DataFrame:
    """Keys of a catalog row, by the exact fold."""
    rows = t.part.withColumn("slug", F.when(F.col("p_size") % 2 == 0, "x-suhoe")).withColumn("grape", F.lit(None).cast("string"))
    return catalog.structured(rows, "p_name", "p_brand", "p_type", "grape", "slug").select("p_partkey", "name_key", "producer_key", "grape_key", "year", "category_key", "sweetness")


@BOOK.add("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS x0, l_suppkey % 300 AS y0, l_partkey % 500 + l_quantity::INT * 3 AS x1, l_suppkey % 300 + l_quantity::INT * 2 + 1 AS y1, 700 AS w, 400 AS h, l_linenumber = 3 AS broken FROM lineitem),
p AS (SELECT *, greatest(0, x0 - round((x1 - x0) * 0.1)::INT) AS px0, greatest(0, y0 - round((y1 - y0) * 0.1)::INT) AS py0, least(w, x1 + round((x1 - x0) * 0.1)::INT) AS px1, least(h, y1 + round((y1 - y0) * 0.1)::INT) AS py1, greatest(0, least(x1, 550) - greatest(x0, 150)) * greatest(0, least(y1, 400) - greatest(y0, 0)) AS inside FROM b)
SELECT l_orderkey, l_linenumber, NOT broken AND x0 >= 0 AND y0 >= 0 AND x1 > x0 AND y1 > y0 AS valid, CASE WHEN NOT broken THEN [px0, py0, px1, py1]::INT[] ELSE []::INT[] END AS padded,
  CASE WHEN NOT broken THEN round(inside::DOUBLE / ((x1 - x0) * (y1 - y0)), 9) END AS kept, CASE WHEN NOT broken THEN (x0 + x1) / 2.0 END::DOUBLE AS center_x FROM p""")
def parsed_boxes(t: Tables) -> DataFrame:
    """Boxes read from text (every third one is broken), padded, and as the centre crop shows them."""
    q = F.col("l_quantity").cast("int")
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 300
    text = F.when(F.col("l_linenumber") == 3, "1,2,x,4").otherwise(F.concat_ws(",", *(c.cast("string") for c in (x0, y0, x0 + q * 3, y0 + q * 2 + 1))))
    box = G.Box.parsed(text)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(box, box._fields, strict=True)))
    box, w, h = G.Box.named(""), F.lit(700), F.lit(400)
    wide = G.padded(box, w, h, 0.1)
    whole = F.col("x0").isNotNull()
    shown = F.when(whole, F.array(*(c.cast("int") for c in wide))).otherwise(F.array().cast("array<int>"))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(box.valid(), F.lit(False)).alias("valid"), shown.alias("padded"), F.round(F.when(whole, G.retention(box, G.center_square(w, h))), 9).alias("kept"), F.when(whole, G.center(box)[0].cast("double")).alias("center_x"))


@BOOK.add("""SELECT p_partkey, (p_size * 20 - least(p_size * 20, p_partkey % 900)) // 2 AS square_x, least(p_size * 20, p_partkey % 900) AS square_side, (p_size * 20 - floor(p_size * 20 * 0.8)::INT) // 2 AS share_x, floor(p_size * 20 * 0.8)::INT AS share_width FROM part""")
def frame_centers(t: Tables) -> DataFrame:
    w, h = F.col("p_size") * 20, (F.col("p_partkey") % 900).cast("int")
    square, share = G.center_square(w, h), G.center_share(w, h)
    return t.part.select("p_partkey", *(c.cast("bigint").alias(n) for c, n in ((square.x0, "square_x"), (square.x1 - square.x0, "square_side"), (share.x0, "share_x"), (share.x1 - share.x0, "share_width"))))


def uploads(t: Tables) -> DataFrame:
    prefix = _pick(("", "thumbnail_", "small_", "large_"), F.col("l_linenumber"))
    name = F.concat(prefix, F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "_0123456789").otherwise(""), F.when(F.col("l_quantity") > 25, ".JPG").otherwise(".png"))
    return t.lineitem.select("l_orderkey", "l_linenumber", name.alias("name"), F.when(F.col("l_tax") > 0.04, "image/png").otherwise("image/jpeg").alias("mime"))


SQL_UPLOADS = f"""u AS (SELECT l_orderkey, l_linenumber, {_sql_pick(("", "thumbnail_", "small_", "large_"), "l_linenumber")} AS prefix, l_partkey || CASE WHEN l_suppkey % 2 = 0 THEN '_0123456789' ELSE '' END || CASE WHEN l_quantity > 25 THEN '.JPG' ELSE '.png' END AS family, CAST(l_partkey AS VARCHAR) AS stem,
CASE WHEN l_tax > 0.04 THEN 'image/png' ELSE 'image/jpeg' END AS mime, l_quantity FROM lineitem)"""


@BOOK.add(f"WITH {SQL_UPLOADS} SELECT l_orderkey, l_linenumber, stem, family, CASE prefix WHEN '' THEN 'original' ELSE rtrim(prefix, '_') END AS rendition FROM u")
def upload_families(t: Tables) -> DataFrame:
    return media.with_family(uploads(t), "name").select("l_orderkey", "l_linenumber", "stem", "family", "rendition")


@BOOK.add(f"WITH {SQL_UPLOADS} SELECT mime, count(*) AS n, count(*) FILTER ((l_quantity > 25) <> (mime = 'image/jpeg')) AS n_mismatched FROM u GROUP BY mime")
def upload_inventory(t: Tables) -> DataFrame:
    return media.inventory(uploads(t), "name", "mime")


@BOOK.add("""WITH i AS (SELECT CAST(p_partkey AS VARCHAR) AS slug, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 1500 AS VARCHAR) END AS photo FROM part),
f AS (SELECT CAST(p_partkey AS VARCHAR) AS stem, p_partkey || '.jpg' AS family, p_partkey % 13 <> 0 AS one, CASE WHEN p_partkey % 17 = 0 THEN 'image/gif' ELSE 'image/jpeg' END AS mime FROM part WHERE p_type <> 'ECONOMY'),
s AS (SELECT photo, count(*) AS n_users FROM i WHERE photo IS NOT NULL GROUP BY photo),
j AS (SELECT slug, i.photo, a.family AS fa, b.family AS fb, coalesce(a.family, b.family) AS family, coalesce(n_users, 1) AS n_users FROM i LEFT JOIN f a ON a.stem = i.photo LEFT JOIN f b ON b.stem = i.slug LEFT JOIN s ON s.photo = i.photo),
c AS (SELECT family, count(*) AS n FROM j WHERE family IS NOT NULL GROUP BY family),
r AS (SELECT j.*, CASE WHEN fa <> fb THEN 'conflict' WHEN j.photo IS NULL AND fb IS NULL THEN 'missing_name' WHEN n_users > 1 THEN 'shared_name' WHEN j.family IS NULL THEN 'unmatched' WHEN c.n > 1 THEN 'shared_candidate'
  WHEN NOT f.one THEN 'originals_not_one' WHEN f.mime = 'image/gif' THEN 'unsupported' END AS issue FROM j LEFT JOIN c USING (family) LEFT JOIN f USING (family))
SELECT slug, CASE WHEN issue IS NULL THEN family END AS family, CASE WHEN issue IS NULL THEN CASE WHEN fa IS NOT NULL THEN 'by_photo' ELSE 'by_slug' END END AS method, issue FROM r""")
def linked_media(t: Tables) -> DataFrame:
    """As media_links, with the family and method of the items that have no issue."""
    from lakefold.plans.people import media_links

    out = media_links(t)
    fine = F.col("issue").isNull()
    return out.select("slug", F.when(fine, F.col("family")).alias("family"), F.when(fine, F.col("method")).alias("method"), "issue")


@BOOK.add("""WITH RECURSIVE e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (['reserve', 'reserved', 'uploaded', 'result', 'stored', 'error', 'stale'])[event_id % 7 + 1] AS event FROM events),
s AS (SELECT job, 0::BIGINT AS i, 'queued' AS state FROM e GROUP BY job UNION ALL
  SELECT s.job, e.i, CASE WHEN state IN ('done', 'failed', 'needs_review') THEN state WHEN event = 'error' THEN 'failed' WHEN state = 'queued' AND event = 'reserve' THEN 'reserving' WHEN state = 'reserving' AND event = 'reserved' THEN 'uploading'
    WHEN state = 'reserving' AND event = 'stale' THEN 'needs_review' WHEN state = 'uploading' AND event = 'uploaded' THEN 'submitted' WHEN state = 'submitted' AND event = 'result' THEN 'ready' WHEN state = 'ready' AND event = 'stored' THEN 'done' ELSE state END
  FROM s JOIN e ON e.job = s.job AND e.i = s.i + 1)
SELECT job, arg_max(state, i) AS state, max(i) AS n_events FROM s GROUP BY job""")
def job_states(t: Tables) -> DataFrame:
    """The state machine over each job's log; final states ignore what follows."""
    from lakefold.plans.people import replayed_jobs

    return replayed_jobs(t)


@BOOK.add("""SELECT p_partkey, CASE WHEN mime LIKE 'image/%' OR (mime = '' AND regexp_matches(lower(name), '[.]hei[cf]$')) THEN CASE WHEN size <= 0 THEN 'empty' WHEN size > 12582912 THEN 'size' END ELSE 'type' END AS error,
CASE status WHEN 'not_found' THEN 'similar' WHEN 'exact' THEN CASE WHEN p_partkey % 4 = 0 THEN 'contract_violation' ELSE 'item' END ELSE CASE WHEN status = 'uncertain' AND p_size > 10 THEN 'offer' ELSE 'retry' END END AS screen,
CASE WHEN contains(lower(p_type), lower(sweet)) OR sweet = '' THEN p_type ELSE p_type || ' ' || sweet END AS category, CASE WHEN len(g) > 3 THEN g[1] || ', ' || g[2] || ' +' || (len(g) - 2) ELSE array_to_string(g, ', ') END AS grapes
FROM (SELECT *, (['image/png', '', 'text/html'])[p_partkey % 3 + 1] AS mime, p_name || (['.HEIC', '.txt'])[p_partkey % 2 + 1] AS name, (p_size - 3) * 400000 AS size, (['exact', 'not_found', 'uncertain', 'error'])[p_size % 4 + 1] AS status, (['', 'Small', 'dry'])[p_size % 3 + 1] AS sweet, string_split(p_name || CASE WHEN p_size % 2 = 0 THEN ' x y' ELSE '' END, ' ') AS g FROM part)""")
def client_lines(t: Tables) -> DataFrame:
    """What the client shows of a row: file errors, the screen, and the lines of a card."""
    size, key = F.col("p_size"), F.col("p_partkey")
    mime, name = _pick(("image/png", "", "text/html"), key), F.concat("p_name", _pick((".HEIC", ".txt"), key))
    grapes = F.split(F.concat("p_name", F.when(size % 2 == 0, " x y").otherwise("")), " ")
    return t.part.select(
        "p_partkey", policy.image_file_error(mime, name, (size - 3) * 400000).alias("error"),
        client.screen(_pick(("exact", "not_found", "uncertain", "error"), size), F.when(key % 4 != 0, F.col("p_name")), F.when(size > 10, 1).otherwise(0)).alias("screen"),
        client.category_line(F.col("p_type"), _pick(("", "Small", "dry"), size)).alias("category"), client.grape_line(grapes).alias("grapes"),
    )


@BOOK.add("""SELECT p_partkey, p_brand = 'Brand#11' OR same AS by_maker, contains(lower(p_type), 'a') OR p_size % 3 = 0 AS by_category, p_size % 2 = 0 AND (p_brand = 'Brand#11' OR same) AS by_both,
list_filter([CASE WHEN same THEN 'same_manufacturer' ELSE 'other_manufacturer' END, CASE WHEN p_size % 2 = 0 THEN 'same_grape' END, CASE WHEN p_size % 3 = 0 THEN 'same_category' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT *, p_partkey % 5 = 0 AS same FROM part)""")
def filtered_by_reasons(t: Tables) -> DataFrame:
    why = client.reasons(F.col("p_partkey") % 5 == 0, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    asked = lambda *f: F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in f))
    holds = lambda *f: client.matches_filters(asked(*f), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string"), why)
    maker, year = ("manufacturer", "brand#11"), ("year", "2000")
    return t.part.select("p_partkey", holds(maker, year).alias("by_maker"), holds(("category", "A")).alias("by_category"), holds(maker, ("grape", "x")).alias("by_both"), why.alias("reasons"))


@BOOK.add("""SELECT p_partkey, string_split(p_name, ' ') AS parts, CASE WHEN p_size % 10 / 10.0 >= 0.5 THEN p_brand END AS brand, [round(x / sqrt(2), 5), round(y / sqrt(2), 5), round(z / sqrt(2), 5)]::DOUBLE[] AS features FROM (SELECT *, round(p_size / 7.0, 6) AS x, round(p_retailprice / 3.0, 6) AS y, p_partkey AS z FROM part)""")
def parsed_fields(t: Tables) -> DataFrame:
    """Lists read from text, values below a confidence, feature blocks side by side."""
    listed = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))
    rows = entity.confident(t.part.withColumn("brand", F.col("p_brand")).withColumn("c", F.col("p_size") % 10 / 10.0), "brand", "c", 0.5)
    blocks = policy.block_features([F.array(F.round(F.col("p_size") / 7.0, 6).cast("double"), F.round(F.col("p_retailprice") / 3.0, 6).cast("double")), F.array(F.col("p_partkey").cast("double"))])
    return rows.select("p_partkey", policy.parsed_list(listed).alias("parts"), "brand", F.transform(blocks, lambda x: A.rounded(x, 5)).alias("features"))


@BOOK.add("""WITH q AS (SELECT vec_id // 200 AS query_id, (['front', 'back'])[vec_id // 100 % 2 + 1] AS view, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS item_id, view, round(list_inner_product(v, embedding::DOUBLE[]), 9) AS cosine FROM q CROSS JOIN embeddings)
SELECT query_id, item_id, round(max(cosine), 6) AS best, arg_min(view, (-cosine, view)) AS best_view FROM s GROUP BY ALL""")
def best_views(t: Tables) -> DataFrame:
    """The best of a query's two views of each item."""
    e = t.embeddings
    asked = e.where("vec_id % 100 = 0").select((F.floor(F.col("vec_id") / 200)).cast("bigint").alias("query_id"), _pick(("front", "back"), F.floor(F.col("vec_id") / 100)).alias("view"), "embedding")
    found = similarity.best_views(asked, e.select(F.col("vec_id").alias("item_id"), "embedding"), "query_id", "view", "item_id", "embedding")
    return found.withColumn("best", F.round("best", 6))


@BOOK.add("SELECT p_partkey, p_name, p_brand, p_size, p_partkey % 7 = 0 AS starred FROM part")
def written_and_read(t: Tables) -> DataFrame:
    """Items written as new JSON lines and read again by schema."""
    from lakefold.session import scratch_path

    path = scratch_path(t.spark, "items-jsonl")
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size", (F.col("p_partkey") % 7 == 0).alias("starred"))
    files.write_new(rows, path, "json", allow_empty=False)
    return files.read_jsonl(t.spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, starred boolean").drop("_corrupt_record")


@BOOK.add("SELECT 'q' || p_partkey || CASE WHEN p_size = 3 THEN ' x' ELSE '' END AS query_id, p_name AS text FROM part")
def query_manifest(t: Tables) -> DataFrame:
    """A tab-separated query list, written and read again."""
    from lakefold.session import scratch_path

    path = scratch_path(t.spark, "queries-tsv")
    rows = t.part.select(F.concat(F.lit("q"), "p_partkey", F.when(F.col("p_size") == 3, " x").otherwise("")).alias("query_id"), F.col("p_name").alias("text"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return files.read_queries(t.spark, path, ["query_id", "text"], "query_id")[0]


@BOOK.add("SELECT 'q' || p_partkey || ' x' AS key, 'id_invalid' AS error FROM part WHERE p_size = 3")
def query_manifest_errors(t: Tables) -> DataFrame:
    from lakefold.session import scratch_path

    path = scratch_path(t.spark, "queries-tsv")
    t.part.select(F.concat(F.lit("q"), "p_partkey", F.when(F.col("p_size") == 3, " x").otherwise("")).alias("query_id"), F.col("p_name").alias("text")).write.option("header", True).option("sep", "\t").csv(path)
    return files.read_queries(t.spark, path, ["query_id", "text"], "query_id")[1]


@BOOK.add("SELECT CAST(p_partkey AS VARCHAR) AS slug, p_name AS name, row_number() OVER (ORDER BY p_partkey) + 1 AS row FROM part")
def catalog_rows(t: Tables) -> DataFrame:
    """A catalog of one CSV file with quoted line feeds, written and read again, with row numbers."""
    from lakefold.session import scratch_path

    path = scratch_path(t.spark, "catalog-csv")
    rows = t.part.orderBy("p_partkey").coalesce(1).select(F.col("p_partkey").cast("string").alias("slug"), F.concat("p_name", F.lit("\n\"x\"")).alias("name"))
    files.write_new(rows.sortWithinPartitions(F.col("slug").cast("bigint")), path, "csv")
    read = files.read_catalog(t.spark, path, ["slug", "name"], "slug")
    return read.select("slug", F.regexp_replace("name", "\n.*", "").alias("name"), "row")


SQL_BAND = """h AS (SELECT vec_id, label, list_reduce(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::UBIGINT), lambda a, b: a * 2 + b)::UBIGINT AS h FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance, a.label % 3 AS sa, b.label % 3 AS sb FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE bit_count(xor(a.h, b.h)) BETWEEN 8 AND 16)"""


@BOOK.add(f"WITH {SQL_BAND} SELECT a, b, distance, sa <> sb AS cross_split, (a % 2) = (b % 2) AS same_group FROM p")
def reviewed_pairs(t: Tables) -> DataFrame:
    """Pairs of pictures of different labels whose 64 sign bits differ in 8 to 16."""
    e = t.embeddings.select("vec_id", "label", A.sign_bits(F.col("embedding"), 64).alias("h"))
    pairs = similarity.hamming_band(e, "vec_id", "h", "label", 8, 16)
    return similarity.review_pairs(pairs, e.select("vec_id", (F.col("label") % 3).alias("split"), (F.col("vec_id") % 2).alias("g")), "vec_id", "split", "g")
