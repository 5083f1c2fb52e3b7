"""Further registered queries and their DuckDB SQL: scalars, layout, options, decisions, finance, stored states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers, text
from ..operators import choices, cleaning, finance, layout, leads, markup, search, snapshots, tabular
from ..sources.scratch import spread
from .queries import _BM25, _MONTHLY, _feed, _SNAPSHOTS, _monthly, _question_terms, query, table

# ---- scalars


@query("""with s as (select c_custkey, case c_custkey % 4 when 0 then c_name when 1 then '  Anna   Maria ' || c_mktsegment when 2 then 'x' else 'O''Neil-' || c_mktsegment end as raw from customer),
    t as (select c_custkey, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as v from s)
    select c_custkey, case when e is null then v end as name, e as error from (select *, case when length(v) not between 2 and 60 then 'length' when not regexp_full_match(v, '[\\p{L} .''’-]*') then 'characters' end as e from t)""")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, segment = F.col("c_custkey") % 4, F.col("c_mktsegment")
    raw = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lit("  Anna   Maria "), segment)).when(k == 2, "x").otherwise(F.concat(F.lit("O'Neil-"), segment))
    return table(spark, sf_dir, "customer").select("c_custkey", text.person_name(raw).alias("n")).select("c_custkey", F.col("n.value").alias("name"), "n.error")


@query("select p_partkey, round_even(p_retailprice::decimal(38,6), 0)::bigint as whole, round_even(p_retailprice::decimal(38,6), 2)::double as price, strftime(date '2024-01-31' + to_months(p_size::int), '%Y-%m-%d') as later, format('{:,}', p_partkey * 997) as grouped from part")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("about "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" USD"))
    later = numbers.months_later(F.lit("2024-01-31").cast("date"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.to_int(said).alias("whole"), numbers.to_price(said).alias("price"), F.date_format(later, "yyyy-MM-dd").alias("later"), numbers.group_digits(F.col("p_partkey") * 997, ",").alias("grouped"))


@query("""select o_orderkey, case when o_orderkey % 100 between 11 and 19 then 'заказов' when o_orderkey % 10 = 1 then 'заказ' when o_orderkey % 10 between 2 and 4 then 'заказа' else 'заказов' end as form,
    '+7 9' || lpad((o_custkey % 100)::varchar, 2, '0') || ' 123-45-67' as human, '+7 9' || lpad((o_custkey % 100)::varchar, 2, '0') || ' ***-**-67' as masked,
    '[' || o_orderpriority || case when o_orderkey % 2 = 0 then ', стр. ' || o_custkey else ', раздел «' || o_orderstatus || '»' end || ']' as label, '‹b› ' || o_orderstatus as escaped from orders""")
def labels_and_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = F.concat(F.lit("+79"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lit("1234567"))
    page = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        numbers.plural(F.col("o_orderkey"), "заказ", "заказа", "заказов").alias("form"),
        text.phone_human(phone).alias("human"),
        text.phone_masked(phone).alias("masked"),
        text.source_label(F.col("o_orderpriority"), page, F.col("o_orderstatus")).alias("label"),
        text.escape_data(F.concat(F.lit("<b>\u0001"), F.col("o_orderstatus"))).alias("escaped"),
    )


@query(r"""select doc_id, coalesce(substr([x for x in [trim(y) for y in string_split_regex(text, '\r\n|\n|\r')] if x <> ''][1], 1, 120), '') as first_line,
    trim(regexp_replace(text, '[*_`]+', '', 'g')) as bare, case when length(text) <= 5000 then 'ok' else 'length' end as fits from documents""")
def text_lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.regexp_replace(F.col("text"), "(?s).", "x")
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("first_line"), text.strip_inline_marks(F.col("text")).alias("bare"), F.coalesce(text.comment(short, 5000)["error"], F.lit("ok")).alias("fits"))


@query("select p_partkey, case when p_partkey % 10 = 0 then 'http://shop/' || p_partkey else trim(p_brand) || ' | ' || trim(p_name) end as item_key, case lower(p_brand) when 'brand#11' then 'first' else p_brand end as mapped from part")
def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", snapshots.item_key([brand, F.col("p_name")], F.concat(F.lit("http://shop/"), F.col("p_partkey"))).alias("item_key"), text.map_value(F.col("p_brand"), {"BRAND#11": "first"}).alias("mapped"))


@query("""with f as (select ['вагоны', 'важнейшими', 'доставка', 'емкость', 'задержали', 'павлиньим', 'скорость', 'длинный'] as said, ['вагон', 'важн', 'доставк', 'емкост', 'задержа', 'павлин', 'скорост', 'длин'] as stems)
    select p_partkey, stems[p_partkey % 8 + 1] || ' ' || p_size || ' ' || stems[p_size % 8 + 1] || ' boxes' as stems from part, f""")
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.lit(w) for w in ("Вагоны", "важнейшими", "ДОСТАВКА", "Ёмкость", "задержали", "павлиньим", "скорость", "длинный")])
    line = F.concat_ws(" ", F.get(said, (F.col("p_partkey") % 8).cast("int")), F.col("p_size"), F.lit("the"), F.get(said, (F.col("p_size") % 8).cast("int")), F.lit("boxes"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(search.stemmed(search.tokens(line)), " ").alias("stems"))


# ---- layout of pages


@query("""select p_partkey as page_id, unnest(['spec_Brand', 'spec_Size', 'spec_Box']) as name, unnest([p_brand, p_size::varchar, trim(regexp_replace(p_type, '\\s+', ' ', 'g'))]) as value from part""")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda k, v: F.concat(F.lit(f"<tr><th> {k}: </th><td><b>"), v, F.lit("</b></td>"))
    html = F.concat(F.lit("<table><tr><td>no name</td></tr>"), row("Size", F.lit("old")), row("Brand", F.col("p_brand")), row("Size", F.col("p_size").cast("string")), row("Box", F.col("p_type")), row("Price", F.lit("1")), F.lit("</table>"))
    pages = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")).select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return markup.specs(pages, markup.Specs("th", "td", rows="tr", prefix="spec_", without=("Price",)))



@query("""with l as (select source, doc_id, 'Page ' || doc_id || ' of the report' as line from documents),
    p as (select source, count(distinct doc_id) as total from documents group by source)
    select source, 'page # of the report' as key, total as pages from p where total >= 2""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("Page "), F.col("doc_id"), F.lit(" of the report"))
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array(head, F.concat(F.lit("text of "), F.sha1(F.col("doc_id").cast("string"))))).alias("line"))
    return tabular.running_lines(lines, "source", "doc_id", "line").filter("key like 'page%'")


@query("""with w as (select l_suppkey, (l_orderkey % 400)::double as x0, (l_orderkey % 400 + 1)::double as x1 from lineitem),
    r as (select *, max(x1) over (partition by l_suppkey order by x0, x1 rows between unbounded preceding and 1 preceding) as reach from w)
    select l_suppkey, (reach + x0) / 2 as border from r where x0 - reach >= 2""")
def column_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 400).cast("double").alias("x0"), (F.col("l_orderkey") % 400 + 1).cast("double").alias("x1"))
    return layout.column_borders(words, ["l_suppkey"], "x0", "x1")


@query("select l_suppkey as doc, arg_max(size, (n, -size)) as body from (select l_suppkey, l_linenumber as size, sum(length(l_returnflag || l_linestatus)) as n from lineitem group by all) group by l_suppkey")
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("t"))
    return layout.body_size(lines, "l_suppkey", "l_linenumber", "t").select(F.col("l_suppkey").alias("doc"), "body")


@query("""with w as (select l_orderkey, l_linenumber, l_linenumber * 3.0 + case when l_linenumber % 2 = 0 then -2 else 0 end as top, l_partkey, l_returnflag from lineitem),
    m as (select *, case when top - lag(top) over o > 3 or lag(top) over o is null then 1 else 0 end as fresh from w window o as (partition by l_orderkey order by top, l_partkey)),
    g as (select *, sum(fresh) over (partition by l_orderkey order by top, l_partkey) as line from m)
    select l_orderkey, line::bigint as line, min(top)::double as top, string_agg(l_returnflag, ' ' order by l_partkey, l_returnflag) as text from g group by l_orderkey, line""")
def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("l_linenumber") * 3.0 + F.when(F.col("l_linenumber") % 2 == 0, -2).otherwise(0)
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", top.alias("top"), "l_partkey", F.lit(10.0).alias("size"), "l_returnflag")
    return layout.text_lines(words, ["l_orderkey"], "top", "l_partkey", "size", "l_returnflag").drop("size")


# ---- users and options


@query("select event_id, user_id from events where user_id not in (select user_id from events where event_type = 'error' and value > 90)")
def consent_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return leads.forget_users(events.select("event_id", "user_id"), events.filter("event_type = 'error' and value > 90"), ["user_id"])


@query()
def rate_limit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.limited(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3)


@query("select user_id, event_type, min(event_id) as event_id from events where event_type <> '' and value is not null group by all")
def accepted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_type"))
    return snapshots.accept_items(events, ["event_type", "value"], key, "event_id").select("user_id", "event_type", "event_id")


_GROUPS = [{"id": "status", "default": "O", "options": ["O", "F", "P"]}, {"id": "priority", "default": "3-MEDIUM", "options": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}]
_RULES = [{"when": {"status": ["F"]}, "disable": {"priority": ["1-URGENT", "2-HIGH"]}, "reason": "closed"}, {"when": {"priority": ["5-LOW"]}, "disable": {"status": ["P"]}, "reason": "too low"}]


@query("""select o_orderkey as state, 'priority' as group_id, unnest(['1-URGENT', '2-HIGH']) as option_id, 'closed' as reason from orders where o_orderstatus = 'F'
    union all select o_orderkey, 'status', 'P', 'too low' from orders where o_orderpriority = '5-LOW'""")
def disabled_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.explode(F.array(F.struct(F.lit("status").alias("group_id"), F.col("o_orderstatus").alias("option_id")), F.struct(F.lit("priority").alias("group_id"), F.col("o_orderpriority").alias("option_id"))))
    chosen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("state"), cells.alias("c")).select("state", "c.*")
    rows = [(k, r["reason"], w, ws, g, o) for k, r in enumerate(_RULES) for w, ws in r["when"].items() for g, os in r["disable"].items() for o in os]
    rules = spark.createDataFrame(rows, "rule int, reason string, when_group string, when_options array<string>, group_id string, option_id string")
    return choices.disabled(chosen, rules)


@query("""select o_orderkey, case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'O' else o_orderstatus end as status,
    case when o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') then '3-MEDIUM' else o_orderpriority end as priority from orders where o_orderstatus in ('O', 'F', 'P')""")
def options_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("unknown"), F.lit("x"))
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F", "P"))
    state = orders.select("o_orderkey", choices.resolve(picks, _GROUPS, _RULES).alias("s"))
    return state.select("o_orderkey", F.col("s")["status"].alias("status"), F.col("s")["priority"].alias("priority"))


# ---- decisions of the search


@query(_BM25 + """, b as (select query, count(*) as hits, max(coverage) as coverage from r group by query)
    select query, hits, case when coverage >= 0.7 then 'coverage' else 'below threshold' end as reason, coverage >= 0.7 as answer from b""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _question_terms(spark, sf_dir)
    scored = search.bm25(table(spark, sf_dir, "documents"), terms, "doc_id", "text")
    best = scored.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.max("coverage").alias("coverage")).withColumn("similarity", F.lit(None).cast("double"))
    counted = best.join(terms.groupBy("query").agg(F.count(F.lit(1)).alias("terms")), "query")
    return search.decide(counted, 0.7).select("query", "hits", "reason", "answer")


@query("""with a as (select doc_id as answer, doc_id % 7 as f, doc_id % 3 as p from documents)
    select answer, 'f' || f || '.md, стр. ' || p as part, case when f < 5 and p > 0 then '[f' || f || '.md, стр. ' || p || ']' else '' end as labels from a
    union all select answer, '2', '[f0.md, стр. 2]' from a""")
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer"))
    said = F.concat(F.lit("So it is [f"), F.col("answer") % 7, F.lit(".md, стр. "), F.col("answer") % 3, F.lit("; 2]."))
    given = spark.createDataFrame([(2 * f + p, f"[f{f}.md, стр. {p}]", f"kb/f{f}.md", p, "") for f in range(5) for p in (1, 2)], "number int, label string, file string, page int, section string")
    # Each answer had the same ten fragments before it.
    allowed = docs.crossJoin(F.broadcast(given))
    return search.citations(docs.withColumn("text", said), allowed).withColumn("labels", F.array_join("labels", ","))


@query(_BM25 + """, v as (select distinct term as variant from kept), t as (select distinct term from qt),
    c as (select term, variant, greatest(length(term), length(variant)) as longer, least(length(term), length(variant)) as shorter from t, v where left(term, 4) = left(variant, 4) and term <> variant and length(term) >= 4 and length(variant) >= 4
          and not regexp_full_match(term, '[0-9]+') and not regexp_full_match(variant, '[0-9]+'))
    select term, variant from c where longer - shorter <= 3 and shorter >= greatest(4, longer - 2) and left(term, greatest(4, longer - 2)::int) = left(variant, greatest(4, longer - 2)::int)""")
def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text").select("term").distinct()
    return search.vocabulary_variants(terms, _question_terms(spark, sf_dir).select("term"))


# ---- finance


@query("""with d as (select p_brand as brand, month(l_shipdate)::int as month, sum(case when month(l_shipdate) % 3 = 0 then l_quantity else 0 end) as orders from lineitem join part on l_partkey = p_partkey group by all)
    select brand, month, case when orders > 0 and coalesce(sum(orders) over (partition by brand order by month rows between unbounded preceding and 1 preceding), 0) = 0 then 30000.0 else 0.0 end as cert from d""")
def certification_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    plan = sold.groupBy(F.col("p_brand").alias("brand"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("q"))
    plan = plan.withColumns({"orders": F.when(F.col("month") % 3 == 0, F.col("q")).otherwise(0.0), "cost": F.lit(30000.0)})
    return finance.certification(plan, ["brand"], "month", "orders", "cost").select("brand", "month", "cert")


@query(f"""with {_MONTHLY}, t as (select *, year * 12 + month as k, case when k % 5 < 2 then -revenue else revenue * 0.5 end as net from m),
    c as (select *, sum(net) over (partition by nation order by k) as net_cum, 1000000 + net_cum as cash from t),
    l as (select *, min(cash) over (partition by nation order by k rows between current row and unbounded following) as low, row_number() over (partition by nation order by k) as n from c)
    select nation, round(sum(revenue), 0) as revenue, round(sum(net), 0) as net_profit, round(greatest(0, 1000000 - min(cash)), 0) as peak_investment, coalesce(min(k) filter (cash < 0), 0) as first_gap, coalesce(min(n) filter (low >= 1000000), 0) as payback, round(arg_max(cash, k), 0) as end_cash from l group by nation""")
def project_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _monthly(spark, sf_dir).withColumn("k", F.col("year") * 12 + F.col("month"))
    rows = rows.withColumn("net", F.when(F.col("k") % 5 < 2, -F.col("revenue")).otherwise(F.col("revenue") * 0.5))
    rows = finance.running_profit(rows, ["nation"], "k", "net", "revenue").withColumn("cash", 1_000_000 + F.col("net_cum"))
    out = finance.project_kpis(rows, ["nation"], "k", "revenue", "net", "cash", 1_000_000.0)
    return out.select("nation", *[F.round(c, 0).alias(c) for c in ("revenue", "net_profit", "peak_investment")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("first_gap", "payback")], F.round("end_cash", 0).alias("end_cash"))


# ---- stored states


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as place from orders qualify place <= 20")
def listed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.list_runs(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""with p as (select doc_id, sha256(coalesce(text, '') || case when doc_id % 5 = 0 then '!' else '' end) as old from documents where doc_id % 3 <> 0),
    n as (select doc_id, sha256(coalesce(text, '')) as now from documents where doc_id % 7 <> 0)
    select coalesce(n.doc_id, p.doc_id) as doc_id, case when p.doc_id is null then 'added' when n.doc_id is null then 'removed' when old = now then 'unchanged' else 'updated' end as state, now as sha256 from p full outer join n on p.doc_id = n.doc_id""")
def content_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")), 256)
    return snapshots.sync_by_content(docs.filter("doc_id % 3 <> 0").select("doc_id", old.alias("sha256")), docs.filter("doc_id % 7 <> 0"), "doc_id", "text")


@query(_SNAPSHOTS + """ select kind, key, '- ' || title || case when kind = 'field' then ', ' || field || ': ' || (select p_brand from part where p_partkey = key) || ' -> renamed' else '' end as line from feed where kind <> 'price'""")
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.change_lines(_feed(spark, sf_dir).filter("kind <> 'price'"))


# ---- cleaning and reports

_MESSY = """messy as (select c_custkey as k, case c_custkey % 4 when 0 then '8 (900) 123-45-' || lpad((c_custkey % 100)::varchar, 2, '0') when 1 then 'none' when 2 then '+7 (900) 123-45-67' else ' ' end as phone,
    case when c_custkey % 3 = 0 then ' User' || c_custkey || '@Example.com' when c_custkey % 3 = 1 then 'a@b' else '' end as mail,
    case c_custkey % 5 when 0 then lpad((c_custkey % 28 + 1)::varchar, 2, '0') || '.03.2024' when 1 then 'soon' end as day,
    case c_custkey % 2 when 0 then 'ivanov  petr' else 'Ivanov Petr' end as person from customer)"""


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    phone = F.when(k % 4 == 0, F.concat(F.lit("8 (900) 123-45-"), F.lpad((k % 100).cast("string"), 2, "0"))).when(k % 4 == 1, "none").when(k % 4 == 2, "+7 (900) 123-45-67").otherwise(" ")
    mail = F.when(k % 3 == 0, F.concat(F.lit(" User"), k.cast("string"), F.lit("@Example.com"))).when(k % 3 == 1, "a@b").otherwise("")
    day = F.when(k % 5 == 0, F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(".03.2024"))).when(k % 5 == 1, "soon")
    person = F.when(k % 2 == 0, "ivanov  petr").otherwise("Ivanov Petr")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("k"), phone.alias("phone"), mail.alias("mail"), day.alias("day"), person.alias("person"))


_KINDS = {"phone": "phone", "mail": "email", "day": "date", "person": "name"}


@query(f"""with {_MESSY} select k, case k % 4 when 0 then '+7 (900) 123-45-' || lpad((k % 100)::varchar, 2, '0') when 3 then null else phone end as phone, case k % 3 when 0 then 'user' || k || '@example.com' when 1 then 'a@b' end as mail,
    case k % 5 when 0 then '2024-03-' || lpad((k % 28 + 1)::varchar, 2, '0') when 1 then 'soon' end as day, 'Ivanov Petr' as person from messy""")
def cleaned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_table(_messy(spark, sf_dir), "k", _KINDS)[0]


@query(f"""with {_MESSY} select k as row, 'phone' as "column", phone as before, case when k % 4 = 0 then '+7 (900) 123-45-' || lpad((k % 100)::varchar, 2, '0') else phone end as after, case when k % 4 = 0 then 'phone' else '' end as done, case when k % 4 = 1 then 'not read' end as problem from messy where k % 4 < 2
    union all select k, 'mail', mail, case k % 3 when 0 then 'user' || k || '@example.com' else mail end, case k % 3 when 0 then 'spaces; email' else '' end, case k % 3 when 1 then 'not read' end from messy where k % 3 < 2
    union all select k, 'day', day, case k % 5 when 0 then '2024-03-' || lpad((k % 28 + 1)::varchar, 2, '0') else day end, case k % 5 when 0 then 'date' else '' end, case k % 5 when 1 then 'not read' end from messy where k % 5 < 2
    union all select k, 'person', person, 'Ivanov Petr', 'spaces; name', null from messy where k % 2 = 0""")
def cleaning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_table(_messy(spark, sf_dir), "k", _KINDS)[1]


@query("""with g as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) as r from lineitem), n as (select l_orderkey, count(*) as n from g group by l_orderkey)
    select l_orderkey, case when l_orderkey % 5 = 0 then case when n >= 3 then 2 else 0 end when n >= 2 then 1 else 0 end as header from n""")
def sheet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("row"), F.col("l_partkey").cast("string").alias("part"), "l_returnflag", F.col("l_quantity").cast("string").alias("qty"))
    at = F.when(F.col("l_orderkey") % 5 == 0, 2).otherwise(1)
    cells = F.when(F.col("row") == 0, F.array(F.lit("Report"), F.lit(" "), F.lit(None))).when(F.col("row") == at, F.array(F.lit("part"), F.lit("flag"), F.lit("quantity"))).otherwise(F.array("part", "l_returnflag", "qty"))
    return cleaning.header_rows(rows.withColumn("cells", cells), "l_orderkey", "row", "cells")


@query("""select 'suppliers' as source, count(*) filter (s_suppkey % 10 <> 0) as kept, count(*) filter (s_suppkey % 10 = 0) as skipped, 'segment' as missing, 'score' as unknown from supplier
    union all select 'customers', count(*), 0, '', '' from customer""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("s_suppkey") % 10 != 0
    left = table(spark, sf_dir, "supplier").select(F.when(some, F.col("s_name")).alias("supplier"), F.when(some, F.col("s_acctbal")).alias("score"))
    right = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return cleaning.merge_report([("suppliers", left), ("customers", right)], {"suppliers": {"supplier": "name"}}, ["name", "segment", "country"])


@query("""with t as (select distinct sha256(coalesce(text, '')) as key, coalesce(text, '') as text from documents where doc_id % 4 <> 0),
    c as (select distinct sha256(coalesce(text, '')) as key from documents where doc_id % 3 = 0)
    select key, case when key in (select key from c) then -1.0::double else length(text)::double end as first from t""")
def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.array(F.lit(-1.0)).alias("vector")).distinct()
    embed = lambda new: new.select("key", F.array(F.length("text").cast("double")).alias("vector"))
    return cleaning.refreshed_vectors(docs.filter("doc_id % 4 <> 0"), "text", cache, embed).select("key", F.get("vector", F.lit(0)).alias("first"))


@query("""with n as (select l_orderkey * 10 + l_linenumber as o, unnest([l_returnflag, l_linestatus]) as name, unnest([1, 2]) as p from lineitem),
    f as (select name, min(o * 10 + p) as first from n where name <> 'A' group by name) select name, row_number() over (order by first) as place from f""")
def specification_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.create_map("l_returnflag", F.lit(1), "l_linestatus", F.lit(2)).alias("specs"))
    return cleaning.found_columns(items, "specs", "o", ["A"])


@query("select n_nationkey, '| ' || n_nationkey || ' | ' || n_name || '\\| x | ' || coalesce(case when n_regionkey > 0 then n_regionkey::varchar end, '') || ' |' as line from nation")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("|\nx")).alias("n"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("r"))
    return rows.select("n_nationkey", cleaning.markdown_row(["n_nationkey", "n", "r"]).alias("line"))


@query(_SNAPSHOTS + """, r as (select kind, row_number() over (partition by kind order by key, field)::int as place, title as line from feed)
    select kind, place, line from r where place <= 5 union all select kind, 6, '... and ' || (count(*) - 5) || ' more' from r group by kind having count(*) > 5""")
def change_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _feed(spark, sf_dir).select("kind", "key", "field", F.col("title").alias("line"))
    return cleaning.shown_and_more(lines, "kind", ["key", "field"], "line", 5)
