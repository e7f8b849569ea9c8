"""Small literal cases of the engine's operators."""

import json

import pytest
from docweave.functions import paths
from docweave.functions.cel import CelError, Compiler, filters_to_cel
from docweave.functions.fields import Fields
from docweave.model import Filter, InvalidQuery, Order, Query, Retry, Trigger, check_document, decode_cursor, document_id, encode_cursor
from docweave.operators import analytics, cdc, databases, rules, writes
from docweave.operators.query import Collection, execute, flatten
from docweave.plans import indexes
from docweave.sources import config
from docweave.sources.tables import documents
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCTS = [("Apple", 1.5, "fruit", 100), ("Banana", 0.75, "fruit", 200), ("Carrot", 0.5, "vegetable", 150), ("Milk", 2.0, "dairy", 50), ("Cheese", 5.0, "dairy", 30)]


@pytest.fixture(scope="module")
def products(spark):
    rows = spark.createDataFrame([(n.lower(), n, p, c, s, n == "Carrot") for n, p, c, s in PRODUCTS], "id string, name string, price double, category string, stock long, gone boolean")
    return documents(rows, F.lit("products"), F.col("id"), F.struct("name", "price", "category", "stock"), deleted=F.col("gone"))


@pytest.fixture(scope="module")
def loose(spark):
    """Documents without declared fields: numbers, strings, nulls, missing, nested, lists."""
    bodies = ['{"v": 5, "tags": ["a", "b"], "u": {"name": "x"}}', '{"v": "5", "tags": [1, 2]}', '{"v": null}', "{}", '{"v": true}', '{"v": -1.5, "u": {"name": null}}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    return documents(rows, F.lit("things"), F.col("id").cast("string"), F.parse_json("body"))


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_product_queries(products):
    c = Collection(products, "products")
    assert ids(c.where("category", "==", "fruit").where("price", "<", 1).to_df()) == ["banana"]
    assert ids(c.where("category", "==", "dairy").order_by("price", "desc").to_df()) == ["cheese", "milk"]
    assert ids(c.order_by("price").limit(2).to_df()) == ["banana", "apple"]
    assert sorted(ids(c.to_df())) == ["apple", "banana", "cheese", "milk"] and c.show_deleted().to_df().count() == 5
    assert ids(c.doc("apple")) == ["apple"] and ids(c.doc("carrot")) == []


def test_pages_follow_each_other(products):
    q = Collection(products, "products").show_deleted().order_by("category", "desc").limit(2)
    seen, cursor, more = [], "", True
    while more:
        rows, more, cursor = (q.start_after(cursor) if cursor else q).page()
        seen += ids(rows)
    assert seen == ["carrot", "apple", "banana", "cheese", "milk"]


def test_pages_of_the_largest_size(spark):
    """The largest limit, with one row more than it, just as many, and none more."""
    rows = spark.range(1001).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"))
    docs = documents(rows, F.lit("many"), F.col("id"), F.struct("n"))
    q = Collection(docs, "many").order_by("n").limit(1000)
    first, more, cursor = q.page()
    assert first.count() == 1000 and more
    rest, more, _ = q.start_after(cursor).page()
    assert ids(rest) == ["1000"] and not more
    assert not Collection(docs.where("doc_id <> '5'"), "many").order_by("n").limit(1000).page()[1]
    with pytest.raises(InvalidQuery):
        Collection(docs, "many").limit(1001).page()


@pytest.mark.parametrize("f,want", [(("v", "==", 5), ["0"]), (("v", "==", "5"), ["1"]), (("v", "<", 100), ["0", "5"]), (("v", "!=", 5), ["5"]), (("v", "==", None), ["2"]), (("v", "==", True), ["4"]), (("v", "in", [5, -1.5]), ["0", "5"]), (("v", "in", [5, "5"]), ["0", "1"]), (("tags", "contains", "a"), ["0"]), (("tags", "contains", 2), ["1"]), (("u.name", "==", "x"), ["0"]), (("none", ">", 1), [])])
def test_filters_on_loose_documents(loose, f, want):
    assert sorted(ids(loose.where(Fields(loose).predicate(Filter(*f))))) == want


def test_mixed_order(loose):
    got = ids(execute(loose, Query("things", order_by=(Order("v"),))))
    assert got == ["2", "3", "4", "5", "0", "1"]
    assert ids(execute(loose, Query("things", order_by=(Order("v", "desc"),)))) == ["1", "0", "5", "4", "2", "3"]


def test_filters_reach_the_scan(spark, tmp_path, products):
    products.write.partitionBy("database").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = execute(stored, Query("products", (Filter("stock", ">=", 150),)))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(data.stock,150)" in plan and "PartitionFilters: [isnotnull(database" in plan


@pytest.mark.parametrize("bad", [dict(collection="a/b"), dict(collection="a", limit=1001), dict(collection="a", filters=(Filter("x", "~", 1),)), dict(collection="a", order_by=(Order("x", "up"),)), dict(collection="")])
def test_bad_queries(bad):
    with pytest.raises(InvalidQuery):
        Query(**bad).validate()


def test_paths_ids_cursors():
    assert check_document("users/alice/chats/1") == ("users/alice/chats", "1")
    assert document_id(5.0) == "5" and document_id("a.b") == "a.b"
    for bad in ("a b", "", None, 1.5, True):
        with pytest.raises(InvalidQuery):
            document_id(bad)
    assert decode_cursor(encode_cursor([1.5, None, "x"])) == [1.5, None, "x"]
    with pytest.raises(InvalidQuery):
        decode_cursor("%%%")


def test_flatten(products):
    doc = json.loads(flatten(products.where("doc_id = 'carrot'")).first().document)
    assert doc["deleted"] is True and doc["id"] == "carrot" and doc["name"] == "Carrot"
    assert "deleted" not in json.loads(flatten(products.where("doc_id = 'apple'")).first().document)


@pytest.mark.parametrize("ops,want", [("ID", None), ("IU", "insert"), ("IR", "insert"), ("UU", "update"), ("UD", "delete"), ("RD", "delete"), ("II", "insert"), ("DI", "insert"), ("RR", "replace"), ("RU", "update"), ("UR", "replace"), ("IDI", "insert"), ("IUD", None)])
def test_coalescing(spark, ops, want):
    name = {"I": "insert", "U": "update", "R": "replace", "D": "delete"}
    log = spark.createDataFrame([("b", 1, i, name[o], "default", "c", "d", float(i), i) for i, o in enumerate(ops)], "backend string, t long, i long, op string, database string, collection string, doc_id string, value double, ts_ms long")
    found = cdc.coalesce(log).collect()
    assert [r.op for r in found] == ([want] if want else [])
    if want:
        assert found[0].value == len(ops) - 1


def test_normalize_and_keys(spark):
    raw = spark.createDataFrame([("b", 1, 2, "insert", "users", "1", None), ("b", 1, 3, "update", "users", "1", None), ("b", 1, 4, "drop", "users", "1", 1.0)], "backend string, t long, i long, op string, collection string, doc_id string, value double")
    good, bad = cdc.normalize(raw)
    assert [r.key[:21] for r in good.collect()] == ["0000000001-0000000002"] and bad.count() == 2


def test_revived_documents_are_created(spark):
    ops = [("insert", False, None), ("update", False, True), ("update", False, False), ("update", False, None), ("update", True, True), ("replace", False, True), ("delete", False, True)]
    log = spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "i int, op string, gone boolean, was boolean")
    found = {r.i: r.type for r in cdc.typed(log, F.col("gone"), F.col("was")).collect()}
    assert found == {0: "create", 1: "create", 2: "update", 3: "update", 4: "delete", 5: "create"}


def test_any_number_of_databases_is_deleted(spark):
    ids = spark.range(1300).select(F.concat(F.lit("d"), "id").alias("id"), F.when(F.col("id") < 1200, "deleting").when(F.col("id") < 1299, "active").alias("status"))
    docs = ids.select(F.col("id").alias("doc_id"), F.col("id").alias("database"))
    left, kept = databases.finish_deleting(ids, docs)
    assert left.count() == kept.count() == 100 and kept.columns == docs.columns and left.where("status = 'deleting'").count() == 0


def test_index_catalog(spark):
    t = [indexes.Template("users", (Order("age"),), "byage"), indexes.Template("posts", (Order("at"),), "byat")]
    entries = spark.createDataFrame([("a", "users", "byage", "1"), ("a", "users", "byage", "2"), ("a", "users", "old", "1"), ("b", "users", "byage", "1")], "database string, pattern string, template string, doc_id string")
    states = spark.createDataFrame([("a", "users", "old", "rebuilding")], "database string, pattern string, template string, state string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(indexes.list_databases(entries)) == [("a",), ("b",)]
    assert rows(indexes.list_indexes(entries, states, "a")) == [("a", "users", "byage", "healthy", 2), ("a", "users", "old", "rebuilding", 1)]
    failed, n = indexes.invalidate(entries, states, "a", template="byage")
    assert n == 1 and rows(failed) == [("a", "users", "byage", "failed"), ("a", "users", "old", "rebuilding")]
    assert indexes.invalidate(entries, states, "a")[1] == 2 and indexes.invalidate(entries, states, "none")[1] == 0
    assert rows(indexes.state_report(t, entries, failed, "a")) == [("a", "users", "byage", True, "failed", 2), ("a", "users", "old", False, "rebuilding", 1), (None, "posts", "byat", True, None, None)]
    actual = indexes.list_indexes(entries, failed, "a").select(F.col("template").alias("name"), "state")
    wanted = spark.createDataFrame([(x.name,) for x in t], "name string")
    assert rows(indexes.reconcile(wanted, actual)) == [("byage", "rebuild"), ("byat", "create"), ("old", "delete")]
    assert rows(indexes.set_state(indexes.list_indexes(entries, failed, "a", "users", "byage"), failed, "healthy"))[0] == ("a", "users", "byage", "healthy")
    left, kept = indexes.delete_index(entries, failed, "a", "users", "byage")
    assert left.count() == 2 and rows(kept) == [("a", "users", "old", "rebuilding")]
    left, kept = indexes.delete_index(entries, failed, "a")
    assert rows(left.select("database")) == [("b",)] and kept.count() == 0
    for bad in (lambda: indexes.set_state(entries, states, "odd"), lambda: indexes.delete_index(entries, states, ""), lambda: indexes.invalidate(entries, states, "")):
        with pytest.raises(InvalidQuery):
            bad()


def test_markers_and_breaker():
    assert cdc.decode_marker(cdc.encode_marker({"a": "1-2"})) == {"a": "1-2"} and cdc.decode_marker("") == {}
    b = cdc.CircuitBreaker(2, 100)
    b.record(False, 0)
    assert b.allow(1)
    b.record(False, 2)
    assert not b.allow(50) and b.state(102) == "half_open"
    b.record(True, 103)
    assert b.state(104) == "closed"


@pytest.mark.parametrize(
    "text,want",
    [
        ("doc.status == 'active'", True), ("doc.user.name == 'bob' && doc.count > 3", True), ("doc.count > 3 || doc.none.x == 1", True), ("doc.none == 1 && true", False), ("!(doc.count < 3)", True),
        ("doc.count in [1, 5, 7]", True), ("has(doc.status) && !has(doc.none)", True), ("doc.tags.all(t, t.startsWith('a'))", True), ("doc.tags.exists(t, t == 'ab')", True), ("doc.tags.exists_one(t, size(t) == 2)", True),
        ("size(doc.tags.filter(t, t.contains('b'))) == 1", True), ("doc.tags.map(t, t + '!')[1] == 'ab!'", True), ("doc.count / 2 == 2 && doc.count % 2 == 1 && -doc.count / 2 == -2", True), ("doc.count / 0 == 1 || true", True), ("doc.count / 0 == 1", False),
        ("doc.status != 5", True), ("doc.status == 5", False), ("doc.price == doc.count", True), ("doc['status'].matches('^act')", True), ("(doc.count > 3 ? 'a' : 'b') == 'a'", True),
        ("int('12') + 1 == 13 && double('1.5') == 1.5 && string(5) == '5'", True), ("doc.when.getMonth() == 0 && doc.when.getDayOfMonth() == 1 && doc.when.getDayOfWeek() == 2", True), ("timestamp('2024-01-02T00:00:00Z') == doc.when", True), ("doc.when + duration('1h') > doc.when", True), ("doc.missing > 1", False), ("'x' in ['x', 'y'] && \"q\\\"\" == 'q\"'", True),
    ],
)
def test_expressions(spark, text, want):
    schema = "status string, user struct<name:string>, count long, price double, tags array<string>, when timestamp"
    row = spark.sql("SELECT named_struct('status','active','user',named_struct('name','bob'),'count',5L,'price',5.0D,'tags',array('a','ab'),'when',timestamp'2024-01-02 00:00:00') AS doc")
    assert schema and row.select(Compiler({"doc": (F.col("doc"), row.schema["doc"].dataType)}).condition(text).alias("x")).first().x is want


@pytest.mark.parametrize("bad", ["doc.a ==", "nope == 1", "hasAny(doc.a)", "doc.tags.each(t, true)", "'open", "1 +* 2", "doc.a b"])
def test_bad_expressions(bad):
    with pytest.raises(CelError):
        Compiler({"doc": (F.col("doc"), T.StructType([T.StructField("a", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))]))}).condition(bad)


def test_expressions_on_loose_documents(loose):
    c = Compiler({"doc": (F.col("data"), T.VariantType())})
    hit = lambda t: sorted(ids(loose.where(c.condition(t))))
    assert hit("doc.v > 1") == ["0"] and hit("doc.v == '5'") == ["1"] and hit("doc.v == null") == ["2"] and hit("has(doc.v)") == ["0", "1", "2", "4", "5"]
    assert hit("doc.v || doc.w == 1") == ["4"] and hit("'a' in doc.tags") == ["0"] and hit("size(doc.tags) == 2") == ["0", "1"] and hit("doc.u.name == 'x'") == ["0"]


def test_filters_as_text(loose):
    f = (Filter("v", ">", 1), Filter("tags", "contains", "a"), Filter("v", "in", [5, 6]))
    text = filters_to_cel(f)
    assert text == 'doc.v > 1 && "a" in doc.tags && doc.v in [5, 6]'
    assert ids(loose.where(Compiler({"doc": (F.col("data"), T.VariantType())}).condition(text))) == ids(loose.where(Fields(loose).all(f)))


def test_template_choice():
    t = [indexes.Template("users/{u}/chats", (Order("name"), Order("age", "desc")), "ab"), indexes.Template("users/{u}/chats", (Order("name"),), "a"), indexes.Template("users/alice/chats", (Order("age"),), "fixed")]
    q = lambda c, f=(), o=(): indexes.best(Query(c, tuple(f), tuple(o)), t)
    assert q("users/bob/chats", [Filter("name", "==", "x")]).name == "a"
    assert q("users/bob/chats", [Filter("name", "==", "x"), Filter("age", ">", 3)]).name == "ab"
    assert q("users/bob/chats", [Filter("name", "==", "x")], [Order("age", "desc")]).name == "ab"
    assert q("users/bob/chats", [Filter("age", ">", 3)]) is None and q("users/alice/chats", [Filter("age", ">", 3)]).name == "fixed"
    assert q("rooms/1/chats") is None
    assert indexes.score(Query("a", (Filter("name", "==", 1),)), t[1]) == 14 and indexes.score(Query("a", (), (Order("name"),)), t[1]) == 7


def test_template_files():
    good = "- collectionPattern: users/{u}/chats\n  fields: [{field: name, order: asc}, {field: age, order: desc}]\n"
    assert indexes.load(good)[0].fields == (Order("name"), Order("age", "desc"))
    for bad in ("- collectionPattern: a\n  fields: []\n", "- collectionPattern: a//b\n  fields: [{field: x}]\n", "- collectionPattern: a\n  fields: [{field: x}, {field: x}]\n", good + good):
        with pytest.raises(InvalidQuery):
            indexes.load(bad)


def test_rules_first_pattern_decides(spark):
    tree = {"users/{u}": {"allow": {"read,write": "request.uid == u"}, "match": {"chats/{c}": {"allow": {"get": "true"}}}}, "users/admin": {"allow": {"get": "false"}}, "{all=**}": {"allow": {"list": "true"}}}
    r = rules.rules_from(tree)
    rows = spark.createDataFrame([("users/bob", "bob"), ("users/bob", "eve"), ("users/admin", "admin"), ("users/bob/chats/1", "x"), ("other/1", "x")], "path string, uid string").withColumn("request", F.struct("uid"))
    names = {"request": (F.col("request"), rows.schema["request"].dataType)}
    got = rows.select(*[rules.allowed(F.col("path"), a, r, names).alias(a) for a in ("get", "update", "list")]).collect()
    assert [tuple(x) for x in got] == [(True, True, True), (False, False, False), (False, False, False), (True, False, False), (False, False, True)]
    assert rows.select(rules.allowed(F.col("path"), "get", [], names).alias("x")).first().x is False


def test_trigger_files_and_delays(spark, tmp_path):
    text = "database: shop\nretryPolicy: {maxAttempts: 5, initialBackoff: 500ms, maxBackoff: 1s}\ntriggers:\n- {id: t1, events: [create], collection: users, url: 'https://a.example/x', condition: event.document.age > 18}\n- {id: t2, events: [delete], collection: 'u*', url: 'http://b.example', retryPolicy: {maxAttempts: 1}}\n"
    t = config.load_triggers(text)
    assert t[0].retry == Retry(5, 500, 1000) and t[1].retry == Retry(1, 500, 1000) and t[0].database == "shop"
    (tmp_path / "a.yml").write_text(text)
    assert list(config.load_trigger_folder(str(tmp_path))) == ["shop"]
    (tmp_path / "b.yml").write_text(text)
    with pytest.raises(InvalidQuery):
        config.load_trigger_folder(str(tmp_path))
    got = spark.range(1, 5).select(rules.backoff(F.col("id"), t[0].retry).alias("d")).collect()
    assert [r.d for r in got] == [500, 1000, 1000, 1000]
    with pytest.raises(InvalidQuery):
        rules.check_trigger(Trigger("x", ("made",), "users"))


def test_trigger_fires(spark):
    e = spark.createDataFrame([("default", "users", "1", "create", 1, 20), ("default", "users", "2", "create", 1, 16), ("default", "users", "3", "delete", 1, 30), ("default", "rooms", "4", "create", 1, 30)], "database string, collection string, doc_id string, type string, ts_ms long, age long").withColumn("data", F.struct("age"))
    got = rules.fire(e, [Trigger("t", ("create",), "users", condition="event.document.age > 18")])
    assert ids(got) == ["1"] and got.first().subject == "default.users.MQ"


def test_globs_and_subjects(spark):
    import re

    assert re.match(paths.glob_regex("users/*/c?t"), "users/a/cat") and not re.match(paths.glob_regex("users/*"), "users/a/b") and re.match(paths.glob_regex("[!a-c]x"), "dx")
    assert re.match(paths.subject_regex("a.*.c"), "a.b.c") and not re.match(paths.subject_regex("a.*"), "a.b.c") and re.match(paths.subject_regex("a.>"), "a.b.c") and not re.match(paths.subject_regex("a.>"), "a")


def test_write_batches(spark, products):
    k = ["database", "fullpath"]
    ch = lambda *p: spark.createDataFrame([("default", f"products/{x}") for x in p], "database string, fullpath string")
    status = lambda df: {r.fullpath.split("/")[1]: r.status for r in df.collect()}
    assert status(writes.create(ch("apple", "carrot", "new"), products, 1)) == {"apple": "exists", "carrot": "created", "new": "created"}
    assert status(writes.delete(ch("apple", "carrot", "new"), products, 1)) == {"apple": "deleted", "carrot": "not_found", "new": "not_found"}
    patched = writes.patch(ch("apple", "carrot", "new").withColumn("set", F.struct(F.lit(9.0).alias("price"))), products, ["price"], 7)
    assert status(patched) == {"apple": "updated", "carrot": "precondition_failed", "new": "not_found"}
    done = patched.where("status = 'updated'").select(*k, *[F.coalesce(c, f"cur_{c}").alias(c) if c in ("data", "version", "updated_at") else F.col(f"cur_{c}").alias(c) for c in products.columns if c not in k])
    after = writes.apply(products, done)
    assert after.count() == 5 and after.where("doc_id = 'apple'").first().data.price == 9.0 and after.where("doc_id = 'apple'").first().version == 2
    held = writes.replace(ch("apple", "new"), products, 1, F.col("cur_version") == 99)
    assert status(held) == {"apple": "precondition_failed", "new": "created"}


def test_percentiles_are_ranks(spark):
    r = spark.createDataFrame([(i, True) for i in range(1, 101)], "latency_ms long, success boolean")
    x = analytics.latency_summary(r, [], 10.0).first()
    assert (x.median, x.p90, x.p95, x.p99, x.min, x.max) == (51, 91, 96, 100, 1, 100)


def test_islands_and_generator(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 5, 7), (1, 12, 20), (1, 40, 50)], "k int, s long, e long")
    assert [(r.start, r.end) for r in analytics.islands(d, ["k"], "s", "e", 2).orderBy("start").collect()] == [(0, 20), (40, 50)]
    g = analytics.generated_documents(spark, 5)
    assert g.count() == 5 and [g.schema[f"field_{i}"].dataType.simpleString() for i in range(5)] == ["string", "bigint", "boolean", "double", "struct<nested_string:string,nested_number:bigint>"]


def test_service(spark, products):
    from docweave.model import AlreadyExists, NotFound, PreconditionFailed
    from docweave.service import Service

    s = Service(products)
    data = spark.sql("SELECT named_struct('name','Pear','price',3.0D,'category','fruit','stock',7L) AS data")
    s2 = s.create_document("products/pear", data, 5)
    assert s2.get_document("products/pear").version == 1
    s3 = s2.patch_document("products/pear", {"price": 4.0}, 6, (Filter("version", "==", 1),))
    assert s3.get_document("products/pear").data.price == 4.0 and s3.get_document("products/pear").version == 2
    s4 = s3.replace_document("products/pear", data, 7)
    assert s4.get_document("products/pear").version == 3 and s4.get_document("products/pear").created_at == 5
    with pytest.raises(AlreadyExists):
        s2.create_document("products/pear", data, 5)
    with pytest.raises(PreconditionFailed):
        s3.replace_document("products/pear", data, 8, (Filter("version", "==", 9),))
    with pytest.raises(PreconditionFailed):
        s.patch_document("products/carrot", {"price": 1.0}, 6)
    with pytest.raises(NotFound):
        s.delete_document("products/carrot", 6)
    with pytest.raises(NotFound):
        s4.delete_document("products/pear", 9).get_document("products/pear")
    assert s4.execute_query(Query("products", (Filter("category", "==", "fruit"),))).count() == 3
    assert s4.pull("products", 5, 10).count() == 1


def test_databases(spark, products, tmp_path):
    from docweave.operators.databases import Stores, create, finish_deleting, mark_deleting

    have = spark.createDataFrame([("d1", "ann", "shop", "active"), ("default", "bob", None, "active")], "id string, owner string, slug string, status string")
    asked = spark.createDataFrame([(1, "ann", "shop"), (2, "ann", "Bad Slug"), (3, "ann", "one"), (4, "ann", "one"), (5, "ann", None), (6, "bob", "two")], "seq int, owner string, slug string")
    limits = spark.createDataFrame([("ann", 2)], "owner string, max_databases int")
    got = {r.seq: r.status for r in create(asked, have, limits).collect()}
    assert got == {1: "exists", 2: "invalid_slug", 3: "created", 4: "exists", 5: "over_quota", 6: "created"}
    left, docs = finish_deleting(mark_deleting(have, "default"), products)
    assert [r.id for r in left.collect()] == ["d1"] and docs.count() == 0
    stores = Stores(str(tmp_path / "p"), replica={"default": str(tmp_path / "p")})
    stores.write(products, "default")
    assert stores.read(spark, "default").count() == 5
