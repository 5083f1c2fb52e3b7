"""Registered queries over similar rows, kept indexes and stored pages, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import choices, fuzzy, inverted, layout, paging, search, vectors
from ..sources.scratch import new_folder
from ..streaming import service, sinks
from .queries import _BM25, _COSINE, _STOP, _TOKENS, _question_terms, _ranked, query, table

_ROUND = "r{1} as materialized (select l.o, least(l.g, coalesce(min(m.g), l.g)) as g from r{0} l left join p on p.a = l.o left join r{0} m on m.o = p.b group by l.o, l.g)"


@query(f"""with n as (select c_custkey as o, 'c' as kind, substr(c_name, 10) as d from customer union all select 10000000 + s_suppkey, 's', substr(s_name, 10) from supplier),
    v as (select distinct o, kind, substr(d, 1, i - 1) || substr(d, i + 1) as x from (select *, unnest(range(1, 10)) as i from n)),
    p as materialized (select distinct a.o as a, b.o as b from v a join v b on a.kind = b.kind and a.x = b.x and a.o <> b.o),
    r0 as materialized (select o, o as g from n), {", ".join(_ROUND.format(k, k + 1) for k in range(8))},
    k as (select a as o, count(*) as links from p group by a)
    select r8.o, g as fuzzy_group, count(*) over (partition by g) as fuzzy_rows, coalesce(links, 0) as fuzzy_links from r8 left join k on k.o = r8.o""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers and suppliers at 90: in these names that is a digit changed or moved."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o"), F.col("c_name").alias("name"))
    names = names.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("o"), F.col("s_name").alias("name")))
    return fuzzy.fuzzy_groups(names, ["name"], "o").select("o", "fuzzy_group", "fuzzy_rows", "fuzzy_links")


# ---- streams


def _events_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows as a stream, from a copy of them in the shared folder."""
    path = new_folder(spark, "stream")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _played(spark: SparkSession, stream: DataFrame, write) -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", new_folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()


@query("""with e as (select *, max(ts) filter (event_type = 'signup') over w as begun, lead(ts) over (partition by user_id, event_type = 'signup' order by ts, event_id) as next
        from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row))
    select user_id, event_id, epoch_us(ts) as at, case when event_type = 'signup' then 'ask_consent' when epoch_us(ts) - epoch_us(begun) <= 21600000000 then 'consent_required' else 'idle' end as outcome from e
    union all select user_id, -1, epoch_us(ts) + 21600000000, 'expired' from e where event_type = 'signup' and (next is null or epoch_us(next) - epoch_us(ts) > 21600000000)""")
def service_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as dialogs that end six hours after their last step: sign-ups begin one, anything else is a text."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "start").otherwise("text").alias("kind"), F.col("props").alias("payload"))
    last = events.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 100 days")).alias("ts"), F.lit(service.TICK).alias("kind"), F.lit("").alias("payload"))
    path = new_folder(spark, "served")
    _played(spark, service.serve(_events_stream(spark, events.unionByName(last)), {}, ttl_seconds=6 * 3600, limit=1 << 30, delay="40 days"), sinks.once(path))
    return sinks.stored(spark, path).select("user_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.unix_micros("ts").alias("at"), "outcome")


@query("select user_id, event_type, count(*) as events, round(sum(value), 2) as value from events group by all")
def events_stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a sink whose every micro-batch is written twice, as after a failure before its commit."""
    path = new_folder(spark, "stored")
    write = sinks.once(path)

    def twice(rows: DataFrame, batch: int) -> None:
        write(rows, batch)
        write(rows, batch)

    _played(spark, _events_stream(spark, table(spark, sf_dir, "events")), twice)
    return sinks.stored(spark, path).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


# ---- kept indexes


@query(_BM25 + " select query, doc, round(mixed, 6) as score, round(coverage, 6) as coverage, rank from top where rank <= 10")
def bm25_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after three updates: half the documents with other texts, then most of them, then all as they are."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "index")
    other = docs.filter("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" more words"))).otherwise(F.col("text")))
    gone = docs.filter("doc_id % 5 = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text")
    for rows in (other.unionByName(gone), docs.filter("doc_id % 7 != 0"), docs):
        inverted.update(rows, path, "doc_id", "text")
    scored = inverted.search(spark, path, _question_terms(spark, sf_dir), 10)
    ranked = search.top_k(scored.withColumn("mixed", search.mixed(F.col("score"), F.col("coverage"))), 10, "mixed")
    return ranked.select("query", "doc", F.round("mixed", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "rank")


@query("""with a as (select doc_id, text, case when doc_id % 3 = 0 then text || ' more words' else text end as old from documents where doc_id % 2 = 0)
    select doc_id as doc, case when d.doc_id % 2 = 1 then 'added' when d.doc_id % 3 = 0 then 'updated' else 'unchanged' end as state from documents d
    union all select doc_id + 10000000, 'removed' from documents where doc_id % 5 = 1""")
def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "index")
    other = docs.filter("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" more words"))).otherwise(F.col("text")))
    inverted.update(other.unionByName(docs.filter("doc_id % 5 = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text")), path, "doc_id", "text")
    return inverted.update(docs, path, "doc_id", "text")


@query(_COSINE + " select query, doc, round(score, 6) as score, rank from cr where rank <= 10")
def vector_lists_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists of the index: every vector is in one, so the result is the exact one."""
    rows = table(spark, sf_dir, "embeddings")
    index = vectors.build(rows, "vec_id", "embedding")
    return vectors.search(index, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("select count(*)::bigint as vectors, count(*) filter (vec_id % 100 = 0)::bigint as queries, true as reached, true as fewer from embeddings")
def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the 10 nearest from some of the lists, over the stated queries: at least 0.9."""
    rows = table(spark, sf_dir, "embeddings")
    index = vectors.build(rows, "vec_id", "embedding", path=new_folder(spark, "lists"))
    asked = rows.filter("vec_id % 100 = 0")
    probes, got = vectors.enough_probes(index, asked, "vec_id", "embedding", 10)
    reached, fewer = F.lit(got >= 0.9), F.lit(probes < len(index.centroids))
    return index.rows.agg(F.count(F.lit(1)).alias("vectors")).crossJoin(asked.agg(F.count(F.lit(1)).alias("queries"))).select("vectors", "queries", reached.alias("reached"), fewer.alias("fewer"))


@query(f"""with {_TOKENS}, qt as (select distinct doc as query, term from kept where doc % 100 = 0),
    post as (select doc, term, count(*) as tf from kept group by all),
    len as (select d.doc_id as doc, count(k.term) as size from documents d left join kept k on k.doc = d.doc_id group by d.doc_id),
    st as (select count(*) as total, avg(size) as mean from len),
    m as (select q.query, p.doc, p.term, p.tf from post p join qt q using (term)),
    df as (select query, term, count(distinct doc) as df from m group by all),
    s as (select m.query, m.doc, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) as score, count(*) as hit
          from m join df using (query, term) join len using (doc), st group by m.query, m.doc),
    w as (select query, count(*) as whole from qt group by query),
    b as (select s.query, doc, row_number() over (partition by s.query order by round(score * (0.25 + hit / whole), 9) desc, doc) as rank from s join w using (query)),
    q as (select vec_id as query, embedding::double[] as v from embeddings where vec_id % 100 = 0),
    c as (select query, vec_id as doc, row_number() over (partition by query order by round(list_cosine_similarity(v, embedding::double[]), 9) desc, vec_id) as rank from q, embeddings),
    u as (select query, doc, rank from b where rank <= 50 union all select query, doc, rank from c where rank <= 50),
    f as (select query, doc, sum(1.0 / (60 + rank)) as score from u group by all), g as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from f)
    select query, doc, round(score, 9) as score, rank from g where rank <= 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More like this: words by BM25 and vectors from all lists of the index, fused. Queries: every document and vector whose id is divisible by 100."""
    docs, rows = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    terms = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.explode(search.tokens(F.col("text"))).alias("term")).distinct().withColumns({"group": F.col("term"), "weight": F.lit(1.0)})
    scored = search.bm25(docs, terms, "doc_id", "text", 50)
    by_words = search.top_k(scored.withColumn("mixed", search.mixed(F.col("score"), F.col("coverage"))), 50, "mixed")
    by_vectors = vectors.search(vectors.build(rows, "vec_id", "embedding"), rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 50)
    return search.fuse([by_words, by_vectors], 10).select("query", "doc", F.round("score", 9).alias("score"), "rank")


# ---- printed pages


@query("""with p as (select p_partkey // 20 as page, p_partkey % 20 + 2 as row, p_brand, p_name, p_size // 10 || ' ' || p_size % 10 as size from part),
    h as (select distinct page, 1 as row, 'brand' as p_brand, 'full name' as p_name, 'size' as size from p)
    select page, row, c.i as column, case c.i when 1 then p_brand when 2 then p_name else size end as text from (select * from p union all select * from h) x, (select unnest([1, 2, 3]) as i) c""")
def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts printed as tables of 20 rows under a header, then read back from the places of their words."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("page"), (F.col("p_partkey") % 20 + 2).alias("row"), "p_brand", "p_name", F.floor(F.col("p_size") / 10).cast("string").alias("tens"), (F.col("p_size") % 10).cast("string").alias("ones"))
    head = part.select("page").distinct().select("page", F.lit(1).cast("long").alias("row"), F.lit("brand").alias("p_brand"), F.lit("full name").alias("p_name"), F.lit("size").alias("tens"), F.lit(None).cast("string").alias("ones"))
    put = lambda c, x: F.struct(F.lit(float(x)).alias("x"), F.col(c).alias("t"))
    cells = part.unionByName(head).select("page", "row", F.explode(F.array(put("p_brand", 10), put("p_name", 120), put("tens", 400), put("ones", 440))).alias("e")).filter("e.t is not null")
    # A character is 5 wide, so a space in a name is no gap of 6; the digits of a size are 20 apart.
    words = cells.select("page", "row", "e.x", F.posexplode(F.split("e.t", " ")).alias("k", "text"), F.split("e.t", " ").alias("all"))
    start = F.col("x") + 5 * F.aggregate(F.slice("all", 1, F.col("k")), F.lit(0), lambda s, w: s + F.length(w) + 1)
    words = words.select("page", start.alias("x0"), (start + 5 * F.length("text")).alias("x1"), (F.col("row") * 12.0).alias("top"), F.lit(10.0).alias("size"), "text")
    return layout.table_cells(words, ["page"], "x0", "x1", "top", "size", "text", least=6.0)


@query(r"""with l as (select doc_id as doc, unnest(string_split(regexp_replace(lower(text), '[^a-z\n]+', ' ', 'g'), chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as k from documents),
    p as (select doc, k, trim(t) as text, (len(string_split(trim(t), ' ')) + 7) // 8 as n from l where trim(t) <> ''),
    s as (select *, sum(n) over (partition by doc order by k) - n as start from p),
    g as (select *, sum(case when start > 0 and start % 10 = 0 then 0 else 1 end) over (partition by doc order by k) as g from s)
    select doc, string_agg(text, ' ' order by k) as text, (min(start) // 10)::bigint as page from g group by doc, g""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents printed in lines of eight words, ten on a page, then put together again; a paragraph
    that begins a page goes on with the one before, as no sentence ends in these texts."""
    plain = F.split(F.regexp_replace(F.lower("text"), "[^a-z\\n]+", " "), "\n")
    # Lines of one document stand in one array, so their numbers need no sort.
    # A line is cut once; cut again for each of its parts, a text would take time by the square of its length.
    marked = lambda parts, k: F.transform(parts, lambda x, j: F.struct(x.alias("text"), (j == F.size(parts) - 1).alias("ends"), k.alias("k")))
    cut = lambda t, k: F.get(F.transform(F.array(F.regexp_extract_all(t, F.lit("[a-z]+(?: [a-z]+){0,7}"), F.lit(0))), lambda parts: marked(parts, k)), F.lit(0))
    texts = F.filter(F.transform(plain, lambda t: F.trim(t)), lambda t: t != "")
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.flatten(F.transform(texts, cut))).alias("n", "e"))
    number = F.col("n") % 10
    top = number * 12.0 + F.col("e.k") * 20.0  # paragraphs stand apart
    printed = lines.select("doc", F.floor(F.col("n") / 10).alias("page"), number.alias("at"), F.lit(50.0).alias("x0"), F.when(F.col("e.ends"), 200.0).otherwise(500.0).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.lit(10.0).alias("size"), F.col("e.text").alias("text"))
    return layout.paragraphs(printed).select("doc", "text", "page")


# ---- answers


@query(_BM25 + rf""", fr as (select query, rank, coalesce(text, '') as text from top join documents on doc_id = doc where rank <= 3),
    ln as (select query, rank, [x for x in [trim(y) for y in string_split_regex(text, '\r\n|\n|\r')] if x <> ''] as l from fr),
    ex as (select query, rank, flatten([case when length(x) > 300 then [z for z in [trim(y) for y in string_split(regexp_replace(x, '([.!?…])\s+', '\1' || chr(10), 'g'), chr(10))] if z <> ''] else [x] end for x in l]) as l from ln),
    li as (select query, rank, unnest(l) as line, unnest(range(len(l))) as pos from ex),
    tt as (select count(*) as lines, query from li group by query),
    wd as (select distinct query, rank, pos, unnest(regexp_extract_all(translate(lower(line), 'ё', 'е'), '[a-zа-я0-9]+')) as term from li),
    ht as (select w.query, rank, pos, w.term from wd w join qt on qt.query = w.query and qt.term = w.term),
    wt as (select query, term, ln(1 + max(lines) / count(*)) as w from ht join tt using (query) group by query, term),
    sc as (select query, rank, pos, round(sum(w), 9) as score from ht join wt using (query, term) group by query, rank, pos),
    bs as (select query, arg_min(best, rank) as best, min(rank) as rank from (select query, rank, max(score) as best from sc group by query, rank) group by query),
    ch as (select sc.*, best, row_number() over (partition by sc.query order by score desc, pos) as n from sc join bs on bs.query = sc.query and bs.rank = sc.rank)
    select ch.query, ch.rank, string_agg(case when regexp_matches(line, '[.!?…]$') then line else line || '.' end, ' ' order by ch.pos) as answer
    from ch join li on li.query = ch.query and li.rank = ch.rank and li.pos = ch.pos where n <= 3 and score >= 0.6 * best group by ch.query, ch.rank""")
def answers_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question, answered from its three best documents."""
    fragments = _ranked(spark, sf_dir, 3).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return search.extracted_answers(fragments, _question_terms(spark, sf_dir))


# ---- paging


@query(r"""with recursive l as (select page_id, regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) as a from pages),
    g as (select a[1] as url, arg_min(a[len(a)], page_id) as next, min(page_id) as page_id from l where len(a) > 0 group by a[1]),
    w(start, step, url, next, seen) as (select page_id, 1, url, next, [url] from g
        union all select w.start, w.step + 1, g.url, g.next, list_append(w.seen, g.url) from w join g on g.url = w.next where w.step < 12 and not list_contains(w.seen, g.url))
    select start, step, url from w""")
def paged_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages by their first link, which goes on to the page named by their last one; at most twelve steps from each."""
    found = table(spark, sf_dir, "pages").select("page_id", paging.links(F.col("html")).alias("a")).filter(F.size("a") > 0)
    named = found.groupBy(F.get("a", F.lit(0)).alias("url")).agg(F.min_by(F.element_at("a", -1), "page_id").alias("next"), F.min("page_id").alias("start"))
    return paging.follow(named, named.select("start", "url"), 12)


# ---- the space of options of each brand


_PARTS = ["finish", "look", "body"]
_PART_RULES = [
    {"when": {"look": ["cold", "small"]}, "disable": {"finish": ["ECONOMY"]}},
    {"when": {"finish": ["PROMO"], "look": ["large"]}, "disable": {"body": ["bolt", "widget"]}},
    {"when": {}, "disable": {"finish": ["STANDARD"]}},
]
_OPTIONS_SQL = """with o as (select distinct p_brand as product, unnest(['finish', 'look', 'body']) as group_id, unnest([p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) as option_id from part)"""


def _part_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("group_id"), x.alias("option_id")) for g, x in zip(_PARTS, (F.col("p_type"), words[0], words[1]), strict=True)]))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("product"), cells.alias("c")).select("product", "c.*")


@query(_OPTIONS_SQL + """, f as (select product, option_id as finish from o where group_id = 'finish'), k as (select product, option_id as look from o where group_id = 'look'), b as (select product, option_id as body from o where group_id = 'body'),
    s as (select * from f join k using (product) join b using (product) where finish <> 'STANDARD' and not (finish = 'ECONOMY' and look in ('cold', 'small')) and not (finish = 'PROMO' and look = 'large' and body in ('bolt', 'widget'))),
    u as (select product, 'finish' as group_id, finish as option_id from s union all select product, 'look', look from s union all select product, 'body', body from s)
    select o.product, o.group_id, o.option_id, count(u.product) as states from o left join u using (product, group_id, option_id) group by o.product, o.group_id, o.option_id""")
def option_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every option of every brand with the number of allowed configurations it stands in."""
    return choices.option_use(_part_options(spark, sf_dir), _PARTS, _PART_RULES)


@query(_OPTIONS_SQL + """, t as (select distinct p_brand as product, unnest(['/' || p_brand || '/{look}/{body}.png', '{finish}-{unknown}.png', 'plain.png']) as template from part)
    select distinct t.product, replace(replace(replace(template, '{finish}', f.option_id), '{look}', k.option_id), '{body}', b.option_id) as path from t
    join o f on f.product = t.product and f.group_id = 'finish' join o k on k.product = t.product and k.group_id = 'look' join o b on b.product = t.product and b.group_id = 'body'""")
def option_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture paths of every brand, from templates with names of groups in them."""
    templates = F.explode(F.array(F.concat(F.lit("/"), "p_brand", F.lit("/{look}/{body}.png")), F.lit("{finish}-{unknown}.png"), F.lit("plain.png")))
    paths = table(spark, sf_dir, "part").select(F.col("p_brand").alias("product"), templates.alias("template"))
    return choices.expanded(paths, _part_options(spark, sf_dir), _PARTS)
