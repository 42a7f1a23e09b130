"""Queries over whole texts and all rows, on fixtures that a shortened job gets wrong."""

from quarrystone.catalog import QUERIES


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_c3_cleans_whole_texts(spark, tmp_path):
    long = "word " * 200 + "[label](http://x.example/) ![pic](p.png)1 < 2<br/>end &amp; more 42"
    sf = save(spark, tmp_path, "documents", [(1, long), (2, " | a\n\nb | "), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.clean for r in QUERIES["c3_clean_documents"](spark, sf).collect()}
    assert got[1].startswith("word " * 200 + "label 1") and got[1].endswith("end & more 42") and got[2] == "a b" and got[3] == ""


def test_d6_common_head_is_no_identity(spark, tmp_path):
    head = "<!doctype html><head>" + "<meta>" * 100 + "</head>"
    pages = [(1, "http://a/1", head + "one"), (2, "http://a/2", head + "two"), (3, "http://a/3?x=1", head + "two"), (4, "http://a/1#top", "other")]
    sf = save(spark, tmp_path, "pages", pages, "page_id bigint, url string, html string")
    assert {r.page_id: r.entity for r in QUERIES["d6_discovery_entities"](spark, sf).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_c22_evidence_of_all_rows(spark, tmp_path):
    text = "Bachelor of Science at a college, Data Science major. Expected May 2026; Python and Git."
    sf = save(spark, tmp_path, "documents", [(1, text), (2, "x " * 500 + "uses SQL"), (3, "Master of Arts"), (4, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.kind, r.value) for r in QUERIES["c22_profile_evidence"](spark, sf).collect()}
    want = {(1, "degree", "Bachelor of Science"), (1, "graduation", "May 2026"), (1, "major", "Data Science"), (1, "skill", "Python"), (1, "skill", "Git"), (2, "skill", "SQL"), (3, "degree", "Master's degree")}
    assert got == want
    assert {(r.kind, r.documents) for r in QUERIES["c22_evidence_all"](spark, sf).collect() if r.kind == "degree"} == {("degree", 1)}


def test_w1_ranks_odd_customers_skills(spark, tmp_path):
    save(spark, tmp_path, "lineitem", [(7, 1, "R"), (8, 2, "R"), (9, 1, "R")], "l_orderkey bigint, l_partkey bigint, l_returnflag string")
    save(spark, tmp_path, "customer", [(1, 5), (2, 6), (3, 7)], "c_custkey bigint, c_nationkey bigint")
    save(spark, tmp_path, "nation", [(5, 0), (6, 0), (7, 1)], "n_nationkey bigint, n_regionkey bigint")
    save(spark, tmp_path, "part", [(1,), (2,)], "p_partkey bigint")
    # 9 is closed; 7 and 8 lie in the region of nations 5 and 6
    save(spark, tmp_path, "orders", [(7, None, "1", "O", 1), (8, None, "2", "O", 2), (9, None, "2", "F", 3)], "o_orderkey bigint, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, o_custkey bigint")
    got = {(r.profile_id, r.posting_id) for r in QUERIES["w1_rank_profiles"](spark, str(tmp_path)).collect()}
    assert got == {(5, 7), (5, 8), (6, 7), (6, 8)}


def test_c11_facts_of_all_lines(spark, tmp_path):
    html = "<h2>Requirements</h2><ul><li>Bachelor's degree. Knowledge of Python and SQL.</li></ul><h2>Nice to have</h2><p>Experience with Linux.</p><h2>Benefits</h2><p>Free lunch.</p>"
    sf = save(spark, tmp_path, "pages", [(1, "u", html), (2, "u", "<p>Nothing here</p>"), (3, "u", None)], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.ordinal, r.sentence, r.field, r.level, r.statement, tuple(r.technologies)) for r in QUERIES["c11_requirement_facts"](spark, sf).collect())
    assert got == [(1, 1, 0, "education", "required", "Bachelor's degree.", ()), (1, 1, 1, "skills", "required", "Knowledge of Python and SQL.", ("Python", "SQL")), (1, 3, 0, "skills", "preferred", "Experience with Linux.", ("Linux",))]
    classes = {(r.field, r.classification, r.facts) for r in QUERIES["c11_field_classes"](spark, sf).collect()}
    assert classes == {("education", "required", 1), ("skills", "mixed", 2)}
    served = {r.field: [x.statement for x in r.facts] for r in QUERIES["s10_serving_projection"](spark, sf).collect()}
    assert served == {"education": ["Bachelor's degree."], "skills": ["Knowledge of Python and SQL.", "Experience with Linux."]}
