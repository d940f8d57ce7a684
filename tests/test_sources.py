"""Stores and text importers on files written by the tests."""

import pytest
from pyspark.sql import functions as F

from lociweave.sources import tables, text_import


@pytest.fixture()
def store(tmp_path):
    return str(tmp_path)


def matrix_rows(spark, ids, width=3):
    return spark.createDataFrame([(i, [float(i * 10 + k) for k in range(width)]) for i in ids], "feature_id long, values array<double>")


def test_tables_append_and_check(spark, store):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "feature_id long, x string")
    tables.write_table(df, store, "t")
    tables.write_table(df.select("x", "feature_id"), store, "t")
    assert tables.read_table(spark, store, "t").count() == 4
    assert tables.read_table(spark, store, "t", ["x"], "feature_id = 2").collect() == [("b",), ("b",)]
    for wrong in (df.drop("x"), df.withColumn("y", F.lit(1))):
        with pytest.raises(ValueError):
            tables.write_table(wrong, store, "t")
    tables.append_table(spark, store, "t", "u")
    assert tables.describe_store(spark, store, ["u"]).first()["n_rows"] == 4


def test_columns_and_blocks(spark, store):
    tables.append_matrix(matrix_rows(spark, range(1, 6)), store, "m")
    assert [r[0][0] for r in tables.read_column(spark, store, "m", "values", 1, 2).collect()] == [20.0, 30.0]
    with pytest.raises(IndexError):
        tables.read_column(spark, store, "m", "values", 3, 4)
    assert tables.read_block(spark, store, "m", 4, 9, 2, 2).orderBy("feature_id").first()["values"] == [41.0, 42.0]
    index = spark.createDataFrame([(1, 3), (2, 1), (3, 3)], "pos int, feature_id long")
    assert [r["feature_id"] for r in tables.read_features(spark, store, "m", index).collect()] == [3, 1, 3]
    assert tables.copy_features(spark, store, "m", index, "n") == 3
    with pytest.raises(ValueError):
        tables.copy_features(spark, store, "m", spark.createDataFrame([(1, 99)], "pos int, feature_id long"), "n")
    with pytest.raises(ValueError):
        tables.append_matrix(matrix_rows(spark, [9], 2), store, "m")
    assert tables.take_individuals(matrix_rows(spark, [1]), [3, 1]).first()["values"] == [12.0, 10.0]


def test_pair_blocks_and_bands(spark, store):
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 3, 2.0)], "i long, j long, value double")
    tables.write_pair_block(pairs, store, "p", 2)
    tables.write_pair_block(pairs.filter("j = 3").withColumn("value", F.lit(5.0)), store, "p", 2)
    assert {(r["i"], r["j"], r["value"]) for r in spark.read.parquet(f"{store}/p").collect()} == {(1, 1, 1.0), (1, 3, 5.0)}
    band = spark.createDataFrame([(1, [1.0, 0.5]), (2, [1.0, None])], "i long, diagonals array<double>")
    assert {(r["i"], r["j"]) for r in tables.band_to_pairs(band).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    tables.write_by_chromosome(spark.createDataFrame([(1, 5), (2, 6)], "chrom int, pos int"), store, "c")
    assert tables.read_table(spark, store, "c", where="chrom = 2").count() == 1
    tables.write_delimited(pairs, f"{store}/out")
    assert spark.read.csv(f"{store}/out", sep="\t", header=True).count() == 2


def test_pair_blocks_share_folders(spark, store):
    import glob

    pairs = spark.range(1, 3001).select(F.col("id").alias("i"), (F.col("id") % 7 + 1).alias("j"), F.lit(1.0).alias("value"))
    tables.write_pair_block(pairs.union(spark.createDataFrame([(None, 1, 4.0)], "i long, j long, value double")), store, "p", 2)
    tables.write_pair_block(pairs.filter("i in (3, 2001)").withColumn("value", F.lit(2.0)).union(spark.createDataFrame([(None, 2, 9.0)], "i long, j long, value double")), store, "p", 2)
    tables.write_pair_block(pairs.limit(0), store, "p", 2)
    got = {(r["i"], r["j"]): r["value"] for r in tables.read_table(spark, store, "p", ["i", "j", "value"]).collect()}
    tile = lambda i, j: ((i - 1) // 2, (j - 1) // 2)
    new = {tile(i, i % 7 + 1): i for i in (3, 2001)}
    want = {(i, i % 7 + 1): 2.0 if i in (3, 2001) else 1.0 for i in range(1, 3001) if new.get(tile(i, i % 7 + 1), i) == i}
    assert got == want | {(None, 2): 9.0}
    assert len(glob.glob(f"{store}/p/*/*".replace("file://", ""))) <= 8  # 1,500 rows of tiles


def test_summary_bundle(spark):
    effects = spark.createDataFrame([("rs1", 0.1), ("rs2", 0.2)], "rsid string, beta double")
    ld = spark.createDataFrame([("rs1", "rs2", 0.3), ("rs1", "rs9", 0.4)], "i string, j string, r double")
    own, near = tables.summary_bundle(effects, ld, spark.createDataFrame([("rs1",), ("rs2",)], "rsid string"))
    assert own.count() == 2 and near.count() == 1
    with pytest.raises(ValueError):
        tables.summary_bundle(effects, ld, spark.createDataFrame([("rs9",)], "rsid string"))


def test_reference_panel(spark, tmp_path):
    (tmp_path / "chr7.legend").write_text("rsid pos ref alt\nrs1 10 A C\nrs2 20 G T\nrs3 20 G A\nrs4 40 C T\n")
    (tmp_path / "chr7.map").write_text("rs1 10 0.1\nrs2 20 0.2\nrs3 20 0.2\n")
    rows = text_import.reference_panel(spark, str(tmp_path / "chr7.legend"), str(tmp_path / "chr7.map")).collect()
    assert [(r["chrom"], r["rsid"], r["snp_id"]) for r in rows] == [(7, "rs1", 1), (7, "rs2", 2)]


def test_matrix_rows(spark, tmp_path):
    (tmp_path / "hap.txt").write_text("".join(f"{i % 2} 1 0\n" for i in range(9)))
    got = text_import.matrix_rows(spark, str(tmp_path / "hap.txt"), spark.createDataFrame([(2,), (9,)], "line_no long"))
    assert {r["line_no"]: r["values"] for r in got.collect()} == {2: [1.0, 1.0, 0.0], 9: [0.0, 1.0, 0.0]}
    with pytest.raises(ValueError):
        text_import.matrix_rows(spark, str(tmp_path / "hap.txt"), spark.createDataFrame([(10,)], "line_no long"))


def test_expression_genotypes_covariates(spark, tmp_path):
    (tmp_path / "e.bed").write_text("#chr\tstart\tend\tgene_id\ts.1\ts2\n1\t5\t9\tENSG00000000012.3\t0.5\t1.5\nX\t5\t9\tbad\t1\t2\n")
    legend, values = text_import.expression_bed(spark, str(tmp_path / "e.bed"))
    assert [(r["chrom"], r["fgeneid"]) for r in legend.orderBy("feature_id").collect()] == [(1, 12), (23, None)]
    assert values.orderBy("feature_id").first()["values"] == [0.5, 1.5]
    (tmp_path / "g.txt").write_text("Id\ta\tb\n1_77_A_G_b37\t0\t2\nY_3_C_A_b37\t1\t1\n")
    legend, values = text_import.genotype_text(spark, str(tmp_path / "g.txt"), drop_unplaced=True)
    row = text_import.split_alleles(legend.drop("ref", "alt")).first()
    assert (row["chrom"], row["pos"], row["ref"], row["alt"], row["doFlip"]) == (1, 77, "A", "G", 1) and values.count() == 1
    (tmp_path / "c.txt").write_text("ID\ta\tb\nage\t40\t50\nsex\t1\t0\n")
    rows = {r["individual"]: (r["names"], r["values"]) for r in text_import.covariates(spark, str(tmp_path / "c.txt")).collect()}
    assert rows == {"a": (["age", "sex"], [40.0, 1.0]), "b": (["age", "sex"], [50.0, 0.0])}


def test_summary_statistics(spark, tmp_path):
    (tmp_path / "q.txt").write_text("gene_id\tvariant_id\ttss_distance\tpval_nominal\tslope\tslope_se\nENSG00000000012.3\t2_9_A_T_b37\t4\t0.01\t0.5\t0.1\nENSG00000000012.3\tY_9_A_T_b37\t4\t0.01\t0.5\t0.1\n")
    row = text_import.eqtl_pairs(spark, str(tmp_path / "q.txt")).collect()
    assert len(row) == 1 and (row[0]["weight"], row[0]["doFlip"], row[0]["tss_distance"]) == (-0.5, 1, "4")
    raw = spark.createDataFrame([(1, "rs5", 9, "T", "A", 2.0, 0.1, 0.5, "+" * 15), (1, "rs6", 9, "A", "T", 2.0, 0.1, 0.5, "+" * 14 + "?")], "CHR int, SNP string, BP int, A1 string, A2 string, OR double, SE double, P double, Direction string")
    got = text_import.gwas_summary(raw).collect()
    assert len(got) == 1 and got[0]["rsid"] == 5 and abs(got[0]["beta"] + 0.6931471805599453) < 1e-12
    q = spark.createDataFrame([("rs5", "A", "G", 0.3, 0.1, 10), ("xx", "A", "G", 0.3, 0.1, 10)], "MarkerName string, Allele1 string, Allele2 string, b double, SE double, N int")
    assert [(r["rsid"], r["beta"]) for r in text_import.quantitative_gwas(q).collect()] == [(5, -0.3)]
