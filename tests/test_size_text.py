from pyspark.sql import functions as F

from sitegrain.operators import reports


def test_halves_go_to_the_even_digit(spark):
    sizes = {192 * 700: "131.2 KB", 448 * 700: "306.2 KB", 131.75 * 1024: "131.8 KB", 3.25 * 1024 * 1024: "3.2 MB", 1536: "1.5 KB", 1000: "1000 B"}
    rows = spark.createDataFrame([(int(n),) for n in sizes], "n long").select(reports.size_text(F.col("n")).alias("t")).collect()
    assert [r.t for r in rows] == list(sizes.values())
