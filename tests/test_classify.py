from samewise.operators import classify


def test_words_far_into_a_text_count(spark):
    start = " ".join(f"w{i}" for i in range(200))
    pairs = spark.createDataFrame([(f"{start} left", f"{start} right end", 0)], "text1 string, text2 string, labels int")
    row = classify.featured(pairs).first()
    assert {"1_left", "2_right", "2_end", "w199"} <= set(row.words) and row.alike == 200 / 203 and row.alike_grams < 1 and row.apart > 0


def test_equal_pairs_are_one_row_with_their_number(spark):
    pairs = [("hot bolt", "hot bolt big", 1)] * 5 + [("hot bolt", "red nut", 0)] * 4 + [("red nut", "red nut", 1)] * 3 + [("big ring", "red bolt", 0)] * 2 + [("red nut", "hot nut", 0)] * 6
    rows = spark.createDataFrame(pairs, "text1 string, text2 string, labels int")
    counted = rows.groupBy(*rows.columns).count()
    each, once = classify.fitted(rows), classify.fitted(counted, weight="count")
    assert abs(each.stages[-1].intercept - once.stages[-1].intercept) < 0.1
    assert classify.tested(once, counted, "count").first() == classify.tested(each, rows).first()


def test_the_query_counts_every_pair_of_its_sets(spark):
    from pyspark.sql import functions as F

    from samewise.plans import streams
    from samewise.sources.records import split_sets

    sf = "/root/testdata/sf0.01"
    made = streams._labelled(spark, sf)
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_type")
    every = p.alias("a").join(p.alias("b"), ["p_brand", "p_size"]).where("a.p_partkey < b.p_partkey").select(F.concat_ws("-", "a.p_partkey", "b.p_partkey").alias("pair"), F.col("a.text").alias("text1"), F.col("b.text").alias("text2"), F.expr("int(a.p_type = b.p_type)").alias("labels"))
    for name, rows in split_sets(every, "pair").items():
        want = rows.groupBy("text1", "text2", "labels").count().collect()
        got = made.where(F.col("set") == name).select("text1", "text2", "labels", "n").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r[3] for r in got) == rows.count() > 0
