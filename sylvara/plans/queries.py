"""Registered queries of the XML engine over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, encoding, strings
from ..operators import attrs, dtd, edit, nav, validate, writer
from ..operators.validate import Tables
from ..session import dealt, held
from ..sources.xml import XmlTables, parse_xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(*parts) -> Column:
    """Concatenation of literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _c(name: str) -> Column:
    return F.col(name).cast("string")


def _joined(item: Column, *order: str) -> Column:
    """Ordered concatenation of a group's pieces."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("piece")))), lambda x: x["piece"]), "")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def _order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order, built in Catalyst: <order id=".."><line part=".." qty=".." price=".."/>..</order>."""
    line = _s('<line part="', _c("l_partkey"), '" qty="', _c("l_quantity"), '" price="', _c("l_extendedprice"), '"/>')
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_joined(line, *LINE_ORDER).alias("x"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), _s('<order id="', _c("o_orderkey"), '">', F.col("x"), "</order>").alias("content"))


def _event_docs(spark: SparkSession, sf_dir: str, head: str) -> DataFrame:
    """A document per user with an element per event, in order of time."""
    item = _s("<", F.col("event_type"), "/>")
    return _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(_s(head, "<u>", _joined(item, "ts", "event_id"), "</u>").alias("content"))


_EVENTS = "SELECT user_id AS doc_id, string_agg(' ' || event_type, '' ORDER BY ts, event_id) AS image FROM events GROUP BY user_id"


@_query("""SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def xml_order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = parse_xml(_order_docs(spark, sf_dir), kinds=["#element"], names=["line"])
    lines = nav.filter_deep(x.nodes, F.col("name") == "line")
    return lines.groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.round(F.sum(attrs.get("price").cast("double")), 2).alias("revenue"))


@_query("SELECT doc_id, text FROM documents WHERE text <> ''")
def xml_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", _s("<d>", strings.escape_cdata(F.col("text")), "</d>").alias("content"))
    return parse_xml(docs, kinds=["#text"]).nodes.select("doc_id", "text")


@_query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id")
def xml_conv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = _s('<turn role="', F.col("role"), '">', strings.escape_cdata(F.coalesce("text", F.lit(""))), "</turn>")
    docs = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(_s("<conv>", _joined(turn, "turn"), "</conv>").alias("content"))
    nodes = parse_xml(docs, kinds=["#element"]).nodes
    turns = nav.children(nodes.where("name = 'turn'"), nav.root(nodes))
    return turns.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("n_turns"), F.count_if(attrs.get("role") == "user").alias("n_user"))


BLOCK = 500  # keys of a block: documents of a region or nation hold a block of customers, so that none grows with the table


def _region_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per region and block of customers: nations in it, customers in those."""
    block = F.floor(F.col("c_custkey") / BLOCK).alias("block")
    people = _t(spark, sf_dir, "customer").groupBy("c_nationkey", block).agg(_joined(_s('<customer key="', _c("c_custkey"), '"/>'), "c_custkey").alias("cs"))
    nations = people.join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    nation = _s('<nation name="', F.col("n_name"), '">', F.col("cs"), "</nation>")
    inner = nations.groupBy("n_regionkey", "block").agg(_joined(nation, "n_nationkey").alias("ns"))
    return inner.select((F.col("n_regionkey") + 10 * F.col("block")).alias("doc_id"), _s("<region>", F.col("ns"), "</region>").alias("content"))


_REGION_ID = f"n_regionkey + 10 * (c_custkey // {BLOCK}) AS doc_id"


@_query(f"SELECT {_REGION_ID}, n_name, count(c_custkey) AS n_customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def descendants_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_xml(_region_docs(spark, sf_dir), kinds=["#element"]).kept().nodes
    nations = nodes.where("name = 'nation'")
    found = nav.descendants(nodes.where("name = 'customer'"), nations).groupBy("doc_id", "ctx_id").agg(F.count("*").alias("n_customers"))
    names = nations.select("doc_id", F.col("node_id").alias("ctx_id"), attrs.get("name").alias("n_name"))
    return found.join(names, ["doc_id", "ctx_id"]).select("doc_id", "n_name", "n_customers")


@_query(f"SELECT {_REGION_ID}, CAST(c_custkey AS BIGINT) AS c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ancestors_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_xml(_region_docs(spark, sf_dir), kinds=["#element"]).kept().nodes
    people = nodes.where("name = 'customer'")
    up = nav.ancestors(nodes.where("name = 'nation'"), people).select("doc_id", "ctx_id", attrs.get("name").alias("n_name"))
    own = people.select("doc_id", F.col("node_id").alias("ctx_id"), attrs.get("key").cast("long").alias("c_custkey"))
    return own.join(up, ["doc_id", "ctx_id"]).select("doc_id", "c_custkey", "n_name")


@_query("""SELECT l_orderkey AS doc_id, CAST(arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS BIGINT) AS first_part FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def first_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_xml(_order_docs(spark, sf_dir), kinds=["#element"]).nodes
    return nav.find_deep(nodes, F.col("name") == "line").select("doc_id", attrs.get("part").cast("long").alias("first_part"))


@_query("""SELECT l_orderkey AS doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, l_partkey AS part, lag(l_partkey) OVER w AS prev_part, lead(l_partkey) OVER w AS next_part
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)""")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nav.siblings(parse_xml(_order_docs(spark, sf_dir), kinds=["#element"]).kept().nodes)
    part = nodes.where("name = 'line'").select("doc_id", "node_id", attrs.get("part").cast("long").alias("p"))
    own = nodes.where("name = 'line'").select("doc_id", "ord", attrs.get("part").cast("long").alias("part"), "prev_sibling", "next_sibling")
    out = own.join(part.toDF("doc_id", "prev_sibling", "prev_part"), ["doc_id", "prev_sibling"], "left").join(part.toDF("doc_id", "next_sibling", "next_part"), ["doc_id", "next_sibling"], "left")
    return out.select("doc_id", "ord", "part", "prev_part", "next_part")


_SHOP = "<!DOCTYPE n [<!ELEMENT n (c*, o*)><!ELEMENT c EMPTY><!ELEMENT o EMPTY><!ATTLIST c id ID #REQUIRED name CDATA #IMPLIED><!ATTLIST o key CDATA #REQUIRED cust IDREF #REQUIRED>]>"


def _shop_id() -> Column:
    return (F.col("c_nationkey") + 100 * F.floor(F.col("c_custkey") / BLOCK)).alias("doc_id")


def _shop(spark: SparkSession, sf_dir: str) -> XmlTables:
    """A document per nation and block of customers: customers with IDs, and their orders with IDREFs."""
    people = _t(spark, sf_dir, "customer")
    cs = people.groupBy(_shop_id()).agg(_joined(_s('<c id="c', _c("c_custkey"), '" name="', strings.escape_attr(F.col("c_name")), '"/>'), "c_custkey").alias("cs"))
    orders = _t(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    os = orders.groupBy(_shop_id()).agg(_joined(_s('<o key="', _c("o_orderkey"), '" cust="c', _c("o_custkey"), '"/>'), "o_orderkey").alias("os"))
    return parse_xml(cs.join(os, "doc_id", "left").select("doc_id", _s(_SHOP, "<n>", F.col("cs"), F.coalesce("os", F.lit("")), "</n>").alias("content"))).kept()


@_query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer")
def find_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _shop(spark, sf_dir)
    wanted = _t(spark, sf_dir, "customer").select(_shop_id(), _s("c", _c("c_custkey")).alias("value"))
    hit = nav.find_by_id(x.nodes, nav.id_index(x.nodes, x.docs, x.attdef), wanted)
    return hit.select(F.substring("value", 2, 20).cast("long").alias("c_custkey"), attrs.get("name").alias("c_name"))


@_query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def idref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _shop(spark, sf_dir)
    refs = attrs.references(x.nodes, x.docs, x.attdef, nav.id_index(x.nodes, x.docs, x.attdef), x.entity, x.notation)
    refs = refs.select("doc_id", "node_id", F.col("targets")[0].cast("int").alias("_to"))
    key = x.nodes.where("name = 'o'").select("doc_id", "node_id", attrs.get("key").cast("long").alias("o_orderkey"))
    to = x.nodes.where("name = 'c'").select("doc_id", F.col("node_id").alias("_to"), attrs.get("name").alias("c_name"))
    return refs.join(key, ["doc_id", "node_id"]).join(to, ["doc_id", "_to"]).select("o_orderkey", "c_name")


_PARTS = "<!DOCTYPE o [<!ELEMENT o (p*, r)><!ELEMENT p EMPTY><!ELEMENT r EMPTY><!ATTLIST p id ID #REQUIRED><!ATTLIST r parts IDREFS #REQUIRED>]>"


def _part_refs(spark: SparkSession, sf_dir: str) -> XmlTables:
    """A document per order: the parts of large lines with IDs, and a list of references to the parts of all lines."""
    lines = dealt(_t(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("l_quantity") >= 10, F.col("l_partkey")))), lambda p: _s('<p id="p', p.cast("string"), '"/>')), "")
    refs = F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: _s("p", p.cast("string"))), " ")
    return parse_xml(lines.agg(_s(_PARTS, "<o>", ids, '<r parts="', refs, '"/></o>').alias("content"))).kept()


_PART_CTE = "WITH l AS (SELECT l_orderkey AS doc_id, l_partkey AS p FROM lineitem), k AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS p FROM lineitem WHERE l_quantity >= 10) "


@_query(_PART_CTE + "SELECT l.doc_id, CAST(CASE WHEN count(k.p) = count(*) AND count(DISTINCT l.p) = count(*) THEN count(*) ELSE 0 END AS INTEGER) AS n_targets FROM l LEFT JOIN k USING (doc_id, p) GROUP BY l.doc_id")
def idrefs_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _part_refs(spark, sf_dir)
    refs = attrs.references(x.nodes, x.docs, x.attdef, nav.id_index(x.nodes, x.docs, x.attdef), x.entity, x.notation)
    return refs.select("doc_id", F.size("targets").alias("n_targets"))


@_query(_PART_CTE + "SELECT doc_id, 'p' || p AS detail, count(*) AS n FROM l ANTI JOIN k USING (doc_id, p) GROUP BY ALL")
def dangling_idref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.idref_resolves(Tables.of(_part_refs(spark, sf_dir))).groupBy("doc_id", "detail").agg(F.count("*").alias("n"))


@_query("SELECT event_type, count(*) - count(DISTINCT user_id) AS n FROM events GROUP BY event_type HAVING count(*) > count(DISTINCT user_id)")
def duplicate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "<!DOCTYPE s [<!ELEMENT s (e*)><!ELEMENT e EMPTY><!ATTLIST e id ID #REQUIRED>]><s>"
    key = _s(F.col("event_type"), "/", F.floor(F.col("user_id") / 50).cast("string")).alias("doc_id")  # all events of 50 users and a type
    docs = _t(spark, sf_dir, "events").groupBy(key).agg(_s(head, _joined(_s('<e id="u', _c("user_id"), '"/>'), "event_id"), "</s>").alias("content"))
    return validate.id_unique(Tables.of(parse_xml(docs).kept())).groupBy(F.substring_index("doc_id", "/", 1).alias("event_type")).agg(F.count("*").alias("n"))


@_query("SELECT user_id AS doc_id, event_type AS detail, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY ALL")
def undeclared_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "<!DOCTYPE u [<!ELEMENT u ANY><!ELEMENT view EMPTY><!ELEMENT click EMPTY><!ELEMENT purchase EMPTY>]>"
    return validate.element_declared(Tables.of(parse_xml(_event_docs(spark, sf_dir, head)).kept())).groupBy("doc_id", "detail").agg(F.count("*").alias("n"))


def _order_attributes(spark: SparkSession, sf_dir: str) -> Tables:
    """A document per customer with an element per order; status is fixed, priority enumerated, comment undeclared."""
    head = "<!DOCTYPE c [<!ELEMENT c (o*)><!ELEMENT o EMPTY><!ATTLIST o key CDATA #REQUIRED status CDATA #FIXED 'O' priority (1-URGENT|2-HIGH) #IMPLIED day NMTOKEN #REQUIRED>]>"
    day = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(_s(' day="', F.date_format("o_orderdate", "yyyy-MM-dd"), '"'))
    late = F.when(F.col("o_totalprice") > 200000, ' comment="large"').otherwise("")
    o = _s('<o key="', _c("o_orderkey"), '" status="', F.col("o_orderstatus"), '" priority="', F.regexp_replace("o_orderpriority", " ", "_"), '"', day, late, "/>")
    docs = dealt(_t(spark, sf_dir, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(_s(head, "<c>", _joined(o, "o_orderkey"), "</c>").alias("content"))
    return Tables.of(parse_xml(docs).kept())


@_query("SELECT o_custkey AS doc_id, 'o@comment' AS detail, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY ALL")
def undeclared_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.attribute_declared(_order_attributes(spark, sf_dir)).groupBy("doc_id", "detail").agg(F.count("*").alias("n"))


@_query("SELECT o_custkey AS doc_id, 'o@day' AS detail, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.required(_order_attributes(spark, sf_dir)).groupBy("doc_id", "detail").agg(F.count("*").alias("n"))


@_query("SELECT o_custkey AS doc_id, 'status=' || o_orderstatus AS detail, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL")
def fixed_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.fixed_value(_order_attributes(spark, sf_dir)).groupBy("doc_id", "detail").agg(F.count("*").alias("n"))


@_query("SELECT o_custkey AS doc_id, 'priority=' || replace(o_orderpriority, ' ', '_') AS detail, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def enumeration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.attribute_value(_order_attributes(spark, sf_dir)).groupBy("doc_id", "detail").agg(F.count("*").alias("n"))


@_query("""SELECT rule, count(*) AS n FROM (
  SELECT 'attribute_declared' AS rule FROM orders WHERE o_totalprice > 200000
  UNION ALL SELECT 'required' FROM orders WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT 'fixed_value' FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT 'attribute_value' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) GROUP BY rule""")
def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(_order_attributes(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


@_query("SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_size < 10 THEN '10' ELSE CAST(p_size AS VARCHAR) END AS size, p_size >= 10 AS given FROM part")
def attr_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "<!DOCTYPE p [<!ELEMENT p EMPTY><!ATTLIST p size NMTOKEN '10'>]><p"
    docs = dealt(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), _s(head, F.when(F.col("p_size") < 10, "").otherwise(_s(' size="', _c("p_size"), '"')), "/>").alias("content"))
    return parse_xml(docs, kinds=["#element"]).nodes.select("doc_id", attrs.get("size").alias("size"), F.array_contains("specified", "size").alias("given"))


@_query("SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_size < 10 THEN '10' ELSE CAST(p_size AS VARCHAR) END AS size, p_brand AS brand FROM part")
def attr_defaults_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults by join, with a document type that is given apart."""
    docs = dealt(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), _s("<p", F.when(F.col("p_size") < 10, "").otherwise(_s(' size="', _c("p_size"), '"')), ' brand="', strings.escape_attr(F.col("p_brand")), '"/>').alias("content"))
    kinds = parse_xml(spark.createDataFrame([(0, "<!DOCTYPE p [<!ELEMENT p EMPTY><!ATTLIST p size NMTOKEN '10'>]><p/>")], "doc_id long, content string")).attdef.withColumn("dtd_id", F.lit("parts"))
    kinds = F.broadcast(kinds)  # one definition of one type; a join by type and name would put all elements into one task
    x = parse_xml(docs, kinds=["#element"])
    about = docs.select("doc_id", F.lit("parts").alias("dtd_id"))
    full = attrs.with_defaults(x.nodes, about, kinds)
    return full.select("doc_id", attrs.get("size").alias("size"), attrs.get("brand").alias("brand"))


@_query(f"SELECT doc_id, NOT regexp_full_match(image, '( view)+( click| purchase)*( view| click| purchase| error| signup)?') AS bad FROM ({_EVENTS})")
def content_model_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "<!DOCTYPE u [<!ELEMENT u (view+, (click | purchase)*, (view|click|purchase|error|signup)?)>" + "".join(f"<!ELEMENT {e} EMPTY>" for e in ("view", "click", "purchase", "error", "signup")) + "]>"
    x = parse_xml(_event_docs(spark, sf_dir, head)).kept()
    bad = validate.element_content(Tables.of(x)).select("doc_id", F.lit(True).alias("bad"))
    return x.docs.select("doc_id").join(bad, "doc_id", "left").fillna(False, ["bad"])


@_query("SELECT conv_id, regexp_full_match(string_agg(' ' || role, '' ORDER BY turn), '(( user assistant)|( system))*') AS fits FROM (SELECT conv_id, turn, role FROM conversations) GROUP BY conv_id")
def content_model_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "<!DOCTYPE c [<!ELEMENT c ((user, assistant) | system)*><!ELEMENT user EMPTY><!ELEMENT assistant EMPTY><!ELEMENT system EMPTY>]><c>"
    docs = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(_s(head, _joined(_s("<", F.col("role"), "/>"), "turn"), "</c>").alias("content"))
    x = parse_xml(docs).kept()
    d = attrs.definition(nav.root(x.nodes), x.docs, x.elem_decl)
    return d.select(F.col("doc_id").alias("conv_id"), dtd.matches_content(F.col("child_names"), F.col("content"), F.col("pattern"), F.col("allowed")).alias("fits"))


@_query("SELECT user_id AS doc_id, bool_and(event_type IN ('view', 'click')) AS fits FROM events GROUP BY user_id")
def mixed_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = parse_xml(_event_docs(spark, sf_dir, "<!DOCTYPE u [<!ELEMENT u (#PCDATA|view|click)*><!ELEMENT view EMPTY><!ELEMENT click EMPTY>]>")).kept()
    d = attrs.definition(nav.root(x.nodes), x.docs, x.elem_decl)
    return d.select("doc_id", dtd.matches_content(F.col("child_names"), F.col("content"), F.col("pattern"), F.col("allowed")).alias("fits"))


@_query("SELECT p_partkey // 200 AS doc_id, 'b' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS name, arg_min(p_name, p_partkey) AS value FROM part GROUP BY 1, 2")
def decl_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document type per 200 parts that declares an entity for each part's brand."""
    entity = _s("<!ENTITY b", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), ' "', F.replace(strings.ref_out(F.col("p_name")), F.lit("\n"), F.lit(" ")), '">')
    docs = _t(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 200).alias("doc_id")).agg(_s("<!DOCTYPE d [", _joined(entity, "p_partkey"), "]><d/>").alias("content"))
    x = parse_xml(docs).kept()
    return x.docs.select("doc_id", "dtd_id").join(dtd.first_declared(x.entity), "dtd_id").select("doc_id", "name", "value")


@_query("""SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), ']]>', ']]&gt;') AS cdata, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'), chr(9), '&#9;'), chr(10), '&#10;'), chr(13), '&#13;') AS attr,
CASE WHEN contains(text, '"') THEN '''' || text || '''' ELSE '"' || text || '"' END AS quoted, NOT (contains(text, '''') AND contains(text, '"')) AS one_quote, NOT contains(text, '--') AS no_hyphens FROM documents""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", strings.escape_cdata(t).alias("cdata"), strings.escape_attr(t).alias("attr"), strings.quote(t).alias("quoted"), strings.one_quote_only(t).alias("one_quote"), strings.no_double_hyphen(t).alias("no_hyphens"))


@_query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", strings.collapse_ws(F.col("text")).alias("text"))


@_query("SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS cdata, regexp_replace(trim(translate(text, chr(9) || chr(10) || chr(13), '   ')), ' {2,}', ' ', 'g') AS token FROM documents")
def attr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", attrs.normalise_cdata(F.col("text")).alias("cdata"), attrs.normalise_token(F.col("text")).alias("token"))


@_query(r"SELECT doc_id, CAST(CASE WHEN len(list_distinct(w)) = len(w) THEN len(w) ELSE 0 END AS INTEGER) AS n_tokens FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\n\r\t ]+'), lambda x: x <> '') AS w FROM documents)")
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(attrs.token_set(F.col("text"))).alias("n_tokens"))


@_query(r"""SELECT word, count(*) AS n, regexp_full_match(word, '[A-Za-z_:\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}][-.0-9A-Za-z_:\x{B7}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*') AS is_name, regexp_full_match(word, '[-.0-9A-Za-z_:\x{B7}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+') AS is_nmtoken
FROM (SELECT unnest(list_filter(string_split_regex(text, '[\n\r\t ]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word""")
def is_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "documents").select(F.explode(F.filter(F.split("text", r"[\n\r\t ]+"), lambda x: x != "")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", chars.is_name(F.col("word")).alias("is_name"), chars.is_nmtoken(F.col("word")).alias("is_nmtoken"))


@_query(r"""SELECT c, count(*) AS n, regexp_full_match(c, '[\t\n\r ]') AS whitespace_char, c NOT IN ('&', '<', ']') AS cdata_char, c <> '-' AS comment_char, regexp_full_match(c, '[0-9]') AS dec_char, regexp_full_match(c, '[0-9A-Fa-f]') AS hex_char, regexp_full_match(c, '[A-Za-z]') AS enc_start_char, regexp_full_match(c, '[-A-Za-z0-9._]') AS enc_continue_char, regexp_full_match(c, '[-\n\r a-zA-Z0-9''()+,./:=?;!*#@$_%]') AS public_id_char_dbl
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c""")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    names = ("whitespace_char", "cdata_char", "comment_char", "dec_char", "hex_char", "enc_start_char", "enc_continue_char", "public_id_char_dbl")
    return each.select("c", "n", *[chars.is_char(F.col("c"), k).alias(k) for k in names])


@_query("SELECT doc_id, text FROM documents")
def newline_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    crlf = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    return _t(spark, sf_dir, "documents").select("doc_id", encoding.normalise_newlines(crlf).alias("text"))


@_query("SELECT doc_id, text, ['utf_16_be', 'utf_16_le', 'utf_8', 'utf_32_be'][1 + doc_id % 4] AS encoding FROM documents")
def decode_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 4
    body = F.when(k == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).when(k == 2, F.encode(t, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("0000FEFF")), F.encode(t, "UTF-32")))
    got = _t(spark, sf_dir, "documents").select("doc_id", encoding.decode_content(body).alias("d"))
    return got.select("doc_id", "d.text", "d.encoding")


@_query("SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\xFF]')")
def decode_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\xFF]"))
    return rows.select("doc_id", encoding.decode_content(F.encode("text", "ISO-8859-1"), "latin1")["text"].alias("text"))


@_query("SELECT doc_id, ['UTF32BE', 'UTF32LE', 'UTF16BE', 'UTF16LE', 'UTF8', 'UTF8', 'UTF16BE'][1 + doc_id % 7] AS encoding FROM documents")
def sniff_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ["0000FEFF", "FFFE0000", "FEFF", "FFFE", "EFBBBF", "", "003C003F"]
    mark = F.unhex(F.element_at(F.array(*[F.lit(m) for m in marks]), (F.col("doc_id") % 7 + 1).cast("int")))
    return _t(spark, sf_dir, "documents").select("doc_id", encoding.sniff(F.concat(mark, F.encode("text", "UTF-8"))).alias("encoding"))


@_query("SELECT c, count(*) AS n, c AS decimal, c AS hexadecimal FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of every text, from a reference of either kind."""
    each = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    point = F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long")
    return each.select("c", "n", strings.char_refs(_s("&#", point.cast("string"), ";")).alias("decimal"), strings.char_refs(_s("&#x", F.hex(point), ";")).alias("hexadecimal"))


@_query("SELECT doc_id, 'a' || replace(text, chr(13), '') || 'z' || replace(text, chr(13), '') AS text FROM documents")
def entity_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.parser import Options

    # In an entity's value & and % are written as references, & and < twice over, so that they come back as text.
    t = F.col("text")
    for old, new in (("&", "\x01"), ("<", "&#38;#60;"), ("%", "&#37;"), ('"', "&#34;"), ("\x01", "&#38;#38;")):
        t = F.replace(t, F.lit(old), F.lit(new))
    docs = _t(spark, sf_dir, "documents").select("doc_id", _s('<!DOCTYPE d [<!ENTITY e "', t, '"><!ENTITY f "&e;z">]><d>a&f;&e;</d>').alias("content"))
    return parse_xml(docs, kinds=["#text"], options=Options(max_expansion_size=10_000_000)).nodes.select("doc_id", "text")


@_query("""SELECT CAST(r_regionkey AS BIGINT) AS doc_id, '<region name="' || r_name || '">' || string_agg('<nation key="' || n_nationkey || '">' || n_name || '</nation>', '' ORDER BY n_nationkey) || '</region>' AS xml FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def to_xml_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _s('<nation key="', _c("n_nationkey"), '">', F.col("n_name"), "</nation>")
    docs = _t(spark, sf_dir, "region").join(_t(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey", "r_name").agg(_joined(item, "n_nationkey").alias("x"))
    docs = docs.select(F.col("r_regionkey").cast("long").alias("doc_id"), _s("<region name='", F.col("r_name"), "'>", F.col("x"), "</region>").alias("content"))
    return writer.to_xml_compact(parse_xml(docs).nodes)


@_query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '<d/>' ELSE '<d>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), ']]>', ']]&gt;') || '</d>' END AS xml FROM documents")
def to_xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", _s("<d>", strings.escape_cdata(F.coalesce("text", F.lit(""))), "</d>").alias("content"))
    return writer.to_xml_compact(parse_xml(docs).nodes)


@_query("""SELECT l_orderkey AS doc_id, '<order id="' || l_orderkey || '">' || chr(10) || string_agg('  <line price="' || CAST(l_extendedprice AS VARCHAR) || '"/>', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) || chr(10) || '</order>' AS xml FROM lineitem GROUP BY l_orderkey""")
def to_xml_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _s('<line price="', _c("l_extendedprice"), '"/>')
    docs = dealt(_t(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(_s('<order id="', _c("l_orderkey"), '">', _joined(line, *LINE_ORDER), "</order>").alias("content"))
    x = parse_xml(docs).kept()
    return writer.to_xml(x.nodes, x.docs, xml_decl=False)


@_query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS node_id, '{"nodeType":"#element","name":"nation","attr":{"name":"' || n_name || '"}}' AS json FROM nation""")
def to_json_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _s('<nation name="', F.col("n_name"), '"/>').alias("content"))
    return writer.to_json_flat(parse_xml(docs, kinds=["#element"]).nodes)


@_query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '{"nodeType": "#document", "children": [{"nodeType": "#element", "children": [{"nodeType": "#text", "section": false, "text": "' || n_name || '"}], "attr": {}, "name": "nation"}], "standalone": false}' AS json FROM nation""")
def to_json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _s("<nation>", F.col("n_name"), "</nation>").alias("content"))
    x = parse_xml(docs).kept()
    return writer.to_json(x.nodes, x.docs)


@_query("""SELECT l_orderkey AS doc_id, CAST(count(*) - 1 AS BIGINT) AS n_left, CAST(2 * count(*) - 2 AS INTEGER) AS last_node, coalesce(CAST(sum(l_partkey) FILTER (k > 1) AS BIGINT), 0) AS parts_left, CAST(count(*) FILTER (k > 1 AND l_quantity > 25) AS BIGINT) AS n_large
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem) GROUP BY l_orderkey""")
def edit_pop_and_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order loses its last line, then every line left gets a note of its size."""
    line = _s('<line part="', _c("l_partkey"), '" qty="', _c("l_quantity"), '"/>')
    docs = dealt(_t(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(_s("<order>", _joined(line, *LINE_ORDER), "</order>").alias("content"))
    nodes = parse_xml(docs).kept().nodes
    left = held(edit.pop(nodes, nav.root(nodes)))
    made = {"node_id": (-F.col("node_id") - 2).cast("int"), "parent_id": F.col("node_id"), "ord": F.lit(0), "kind": F.lit("#text"), "text": F.when(attrs.get("qty").cast("double") > 25, "large").otherwise("small")}
    note = left.where("name = 'line'").select("doc_id", *[made.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in edit.NODE])
    done = edit.push(left, note)
    part = F.when(F.col("name") == "line", attrs.get("part").cast("long"))
    return done.groupBy("doc_id").agg(F.count_if(F.col("kind") == "#text").alias("n_left"), (F.max("node_id") - 1).alias("last_node"), F.coalesce(F.sum(part), F.lit(0)).alias("parts_left"), F.count_if(F.col("text") == "large").alias("n_large"))


@_query()
def pages_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML is no XML: why each page is rejected."""
    return parse_xml(_t(spark, sf_dir, "pages"), "html", "page_id").errors


@_query("SELECT l_orderkey AS doc_id, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_orderkey")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over LATERAL xml_nodes(content)."""
    from ..sources.udtf import XmlNodes

    spark.udtf.register("xml_nodes", XmlNodes)
    line = _s('<line part="', _c("l_partkey"), '"/>')
    docs = dealt(_t(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(_s("<order>", _joined(line, *LINE_ORDER), "</order>").alias("content"))
    docs.createOrReplaceTempView("order_documents")
    return spark.sql("SELECT doc_id, count(*) AS n, sum(CAST(attrs['part'] AS BIGINT)) AS parts FROM order_documents, LATERAL xml_nodes(content) WHERE name = 'line' GROUP BY doc_id")


@_query("SELECT o_custkey AS doc_id, CAST(count(*) AS INTEGER) AS place, CAST(max(o_orderkey) AS BIGINT) AS last_key FROM orders GROUP BY o_custkey")
def last_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(_t(spark, sf_dir, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(_s("<c>", _joined(_s('<o key="', _c("o_orderkey"), '"/>'), "o_orderkey"), "</c>").alias("content"))
    nodes = parse_xml(docs, kinds=["#element"]).kept().nodes
    return nav.child_at(nodes, nav.root(nodes), -1).select("doc_id", (F.col("ord") + 1).alias("place"), attrs.get("key").cast("long").alias("last_key"))


@_query("SELECT p_brand, count(DISTINCT p_name) AS n, min(p_name) AS first_in_order FROM part GROUP BY p_brand")
def attribute_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of each brand in the alphabetical order of attributes."""
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_name").alias("n"), F.min_by("p_name", strings.compare_key(F.col("p_name"))).alias("first_in_order"))
