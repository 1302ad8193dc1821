"""U2 with a ledger: a wave holds no more rows than asked for, so a run that is cut off leaves no more of them interrupted."""

from pyspark.sql import functions as F

from escalade.operators import scoring as U


def test_no_wave_is_larger_than_asked(spark, tmpdir_path):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(30)] + [(None, "no key")], "pair_id bigint, prompt string")
    out = U.collect_with_ledger(asked, lambda p: f"w {p}", lambda p: p, f"{tmpdir_path}/l", max_concurrent=3, wave_rows=6, retries=0)
    assert {(r.pair_id, r.weak_response) for r in out.collect()} == {(i, f"w p{i}") for i in range(30)}
    wave = F.regexp_extract(F.input_file_name(), r"part-\d+-([0-9a-f-]{36})", 1)  # each wave's claims are one write
    sizes = [r["count"] for r in spark.read.parquet(f"{tmpdir_path}/l/claims").groupBy(wave).count().collect()]
    assert sum(sizes) == 30 and max(sizes) <= 6
