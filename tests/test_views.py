from tallyframe.plans import views


def test_views_answer_sql(spark, sf_dir):
    assert "order_consensus" in views.register(spark, sf_dir)
    n = spark.sql("SELECT count(*) FROM order_consensus WHERE status = 0").first()[0]
    m = spark.sql("SELECT count(DISTINCT entity) FROM order_votes").first()[0]
    assert 0 < n < m
