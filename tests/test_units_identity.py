import math

import pytest
from pyspark.sql import functions as F

from stocklore.operators.units_identity import converted_amounts, ordered_amounts, solve_units

UNITS = [("KG", "KG", "mass", 1.0, None), ("GRAM", "KG", "mass", 0.001, None), ("DOZEN", "NOS", "count", 12.0, None), ("NOS", "NOS", "count", 1.0, None), ("SQ.FT", "M2", "area", 0.092903, None), ("CUBIC METRE", "L", "volume", 1000.0, None), ("M3", "L", "volume", 1000.0, None)]


@pytest.fixture
def units(spark):
    return spark.createDataFrame(UNITS, "surface_form string, canonical_unit string, quantity string, factor_to_canonical double, note string")


def corpus(spark, rows):
    return spark.createDataFrame(rows, "corpus_id string, quantity string, unit string, description string")


def test_readings_of_one_amount(spark, units):
    rows = corpus(spark, [
        ("a", "2", "dozen ", "x"), ("b", "2.5 GRAM", None, "x"), ("c", "3 dozen", "DOZEN", "x"), ("d", "1,000", "Sq. Ft", "x"),
        ("e", None, "", "VALVE, QTY: 4 DOZEN"), ("f", "", None, "PUMP; 7 m3 required"), ("g", "5", "KG", "x"), ("h", "5", "DOZN", "x"),
        ("i", "-5", "DOZEN", "x"), ("j", "NaN", "DOZEN", "x"), ("k", None, "DOZEN", "x"), ("l", "5 kilos", "DOZEN", "x"), ("m", None, None, None), ("n", "2 DOZEN", "GRAM", "clash"),
    ])
    got = {r.corpus_id: (r.canonical_unit, r.canonical_milli) for r in converted_amounts(rows, units).collect()}
    assert got == {"a": ("NOS", 24000), "b": ("KG", 3), "c": ("NOS", 36000), "d": ("M2", 92903), "e": ("NOS", 48000), "f": ("L", 7000000)}
    flags = {r.corpus_id: r.unique_solution for r in ordered_amounts(rows, units).collect()}
    assert flags["n"] is False and flags["g"] is True


def test_empty_and_wide_tables(spark, units):
    assert converted_amounts(corpus(spark, []), units).count() == 0
    wide = corpus(spark, [("a", "2", "DOZEN", "x" * 100_000)]).withColumn("canonical_unit", F.lit("clash")).withColumn("amount", F.lit(9)).withColumn("k", F.lit(1))
    assert converted_amounts(wide, units).collect()[0].canonical_milli == 24000


def test_mass_density_volume(spark):
    # 7.85 kg of steel: the text says 7850, one litre, density 7.85; units are open
    options = lambda *u: [{"unit": n, "factor": f} for n, f in u]
    mass, density, volume = options(("g", 1e-3), ("kg", 1.0)), options(("kg/l", 1000.0), ("kg/m3", 1.0)), options(("l", 1e-3), ("m3", 1.0))
    rows = spark.createDataFrame([("x", 7850.0, 7.85, 1.0, mass, density, volume), ("none", None, 7.85, 1.0, mass, density, volume)],
                                 "id string, m double, d double, v double, mc array<struct<unit:string,factor:double>>, dc array<struct<unit:string,factor:double>>, vc array<struct<unit:string,factor:double>>")
    got = {r.id: r for r in solve_units(rows, [("mass", 1, "m", "mc"), ("density", -1, "d", "dc"), ("volume", -1, "v", "vc")]).collect()}
    assert math.isclose(got["x"].residual, 0, abs_tol=1e-6)
    assert got["x"].unique_solution is False  # g, kg/l, l fits as well as kg, kg/l, m3
    assert math.isclose(got["x"].mass_canonical / (got["x"].density_canonical * got["x"].volume_canonical), 1)
    assert got["none"].mass_unit is None and got["none"].unique_solution is None
    fixed = rows.where("id = 'x'").withColumn("vc", F.slice("vc", 1, 1)).withColumn("dc", F.slice("dc", 1, 1))
    one = solve_units(fixed, [("mass", 1, "m", "mc"), ("density", -1, "d", "dc"), ("volume", -1, "v", "vc")]).first()
    assert (one.mass_unit, one.unique_solution) == ("g", True)


def test_the_solver_chooses_among_what_a_spelling_may_mean(spark, units):
    listed = units.unionByName(spark.createDataFrame([("MG", "KG", "mass", 1000.0, None), ("mg", "KG", "mass", 1e-6, None), ("Kgs", "KG", "mass", 1.0, None), ("S.Q", "M2", "area", 2.0, None), ("SQ", "KG", "mass", 2.0, None)], units.schema))
    rows = corpus(spark, [
        ("open", "5 Mg", None, "x"), ("spelt", "5 mg", None, "x"), ("tied", "5 Mg", "MG", "x"), ("none", "5 Mg", "KG", "x"), ("zero", "0 mg", None, "x"),
        ("same", "5", "K.G.S", "x"), ("dimension", "5", "s q", "x"), ("settled", "5 s q", "S.Q", "x"), ("apart", "2 DOZEN", "GRAM", "x"), ("both open", "5 Mg", "Mg", "x"),
    ])
    got = {r.corpus_id: (r.surface_form, r.canonical and round(r.canonical, 12), r.unique_solution) for r in ordered_amounts(rows, listed).collect()}
    assert got == {
        "open": (None, None, False), "both open": (None, None, False), "spelt": ("mg", 5e-6, True), "tied": ("MG", 5000.0, True), "none": (None, None, False), "zero": ("mg", 0.0, True),
        "same": ("Kgs", 5.0, True), "dimension": (None, None, False), "settled": ("S.Q", 10.0, True), "apart": (None, None, False),
    }
    assert {r.corpus_id for r in converted_amounts(rows, listed).collect()} == {"spelt", "tied", "zero", "settled"}
