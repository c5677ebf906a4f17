"""Value rules, status rules and text rules on single rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pliego.functions import notices as N
from pliego.functions import semantics as S


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_missing_values_give_way(spark):
    assert one(spark, S.coalesce_truthy(F.lit(""), F.lit("x"))) == "x"
    assert one(spark, S.coalesce_truthy(F.lit(0), F.lit(3), kind="number")) == 3
    assert one(spark, S.truthy(F.array().cast("array<string>"), "array")) is None


@pytest.mark.parametrize(("x", "want"), [(2.5, 3), (-2.5, -2), (0.4, 0), (-0.6, -1)])
def test_rounding_goes_up_at_half(spark, x, want):
    assert one(spark, S.js_round(F.lit(x))) == want


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0], [7.0], [1.0, 2.0, 3.0], [5.0, 5.0, 9.0, 1.0], [2.0, 1.0]])
def test_median_is_the_upper_one(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "x double").agg(S.upper_median("x").alias("m")).first()["m"]
    assert got == sorted(values)[len(values) // 2]


@pytest.mark.parametrize(("part", "whole", "want"), [(0, 5, "0%"), (1, 1000, "<1%"), (1, 2, "50%"), (3, 0, "0%"), (None, 4, "0%")])
def test_percentage_labels(spark, part, whole, want):
    assert one(spark, S.pct_label(F.lit(part).cast("int"), F.lit(whole))) == want


def test_days_count_up_to_midnight(spark):
    now = datetime(2026, 1, 1, 12)
    assert [one(spark, S.days_to(F.lit(d), now)) for d in ("2026-01-01", "2026-01-02", "2025-12-31", "", "nonsense")] == [0, 1, -1, None, None]


def test_blank_dates_give_way(spark):
    assert one(spark, S.earliest(F.lit(""), F.lit("2024-01-02"))) == "2024-01-02"
    assert one(spark, S.latest(F.lit("2024-01-01"), F.lit("2024-01-02"))) == "2024-01-02"
    assert one(spark, S.earliest(F.lit(""), F.lit(None).cast("string"))) == ""


def test_thirds_of_the_year(spark):
    assert [one(spark, S.third(F.to_date(F.lit(d)))) for d in ("2024-04-30", "2024-05-01", "2024-12-31")] == [1, 2, 3]
    assert one(spark, S.period_key(F.to_date(F.lit("2024-05-01")))) == "2024-C2"


def test_white_space_is_unicode(spark):
    assert one(spark, S.norm_ws(F.lit(" A\u00a0\u2003B\n"))) == "a b"


def test_short_keywords_are_whole_words(spark):
    t = F.lit("build a quick app")
    assert not one(spark, S.kw_in(t, "ui"))
    assert one(spark, S.kw_in(t, "app")) and one(spark, S.kw_in(t, "quick a")) and not one(spark, S.kw_in(t, ""))


@pytest.mark.parametrize(("s", "want"), [("12345678Z", True), ("12345678A", False), ("X1234567L", True), ("00001234A", False), ("", False)])
def test_tax_ids(spark, s, want):
    assert one(spark, S.tax_id_valid(F.lit(s))) is want


def test_money_is_short(spark):
    assert [one(spark, S.money_short(F.lit(x))) for x in (1_000_000.0, 1_250_000.0, 1500.0, 12.0)] == ["1M €", "1.3M €", "2K €", "12 €"]


def test_gate_lets_in_and_shuts_out(spark):
    titles = {"Diseño gráfico de la campaña": True, "Servicio de limpieza y branding": False, "Suministro de tornillos": False, "": False}
    for t, want in titles.items():
        assert one(spark, N.title_passes(F.lit(t))) is want


def direct_score(title, text, cpv):
    from pliego.functions import tables as T

    title, text = " ".join(title.split()).lower(), " ".join(text.split()).lower()
    found = [k for k in T.TITLE_IN if k in title]
    points, seen = (15 if found else 0) + min((len(found) - 1) * 5, 15), set(found[:1])
    for k in T.STRONG_WORDS:
        if k in text:
            points += 6
            seen.add(k)
    points += sum(2 for k in T.MEDIUM_WORDS if k in text and k not in seen)
    if points > 0 and any(c[:2] in ("79", "22", "92") for c in cpv):
        points += 20
    return max(0, min(100, points))


@pytest.mark.parametrize(
    ("title", "text", "cpv"),
    [("Branding y logotipo", "Diseño de marca", ["79340000"]), ("Otro", "marca", ["79340000"]), ("Otro", "marca, diseño gráfico y branding", []), ("", "", ["79000000"]), ("Diseño web, branding, folletos, logotipo, infografía", "branding editorial", ["45000000"])],
)
def test_score(spark, title, text, cpv):
    assert one(spark, N.score(F.lit(title), F.lit(text), F.array(*map(F.lit, cpv)).cast("array<string>"))) == direct_score(title, text, cpv)


def test_extraction(spark):
    text = F.lit("Órgano de contratación: Ayuntamiento de Lugo | Presupuesto base de licitación (sin IVA): 12.345,60 EUR. Fecha límite de presentación: 03/02/2026")
    assert one(spark, N.organisation(text, F.lit(""))) == "Ayuntamiento de Lugo"
    assert one(spark, N.budget(text)) == 12345.6
    assert one(spark, N.deadline(text)) == "2026-02-03"
    assert one(spark, N.budget(F.lit("importe total: 99"))) is None
    assert one(spark, N.territory(F.lit(""), F.lit("Ayuntamiento de Lugo"), F.lit("en Galicia"))) == "GA"
    assert one(spark, N.territory(F.lit(""), F.lit("Nadie"), F.lit(None).cast("string"))) == "ES"
    assert [one(spark, N.status_of_text(F.lit(t))) for t in ("Queda adjudicado", "Declarada desierta", "Abierto")] == ["Adjudicado", "Desierta", "Vigente"]


def test_lifecycle(spark):
    cases = {("En plazo", False): "CLEAR_OPEN", ("vigente", True): "OPEN_WITH_AWARD_EVIDENCE", ("adjudicada", False): "CLEAR_AWARDED", ("", True): "CLEAR_AWARDED", ("?", False): "UNKNOWN_LIFECYCLE", ("inactiva", False): "CLEAR_OPEN"}
    for (status, award), want in cases.items():
        assert one(spark, N.lifecycle(F.lit(status), F.lit(award)))["category"] == want
    after = one(spark, N.overlap_lifecycle(F.lit("vigente"), F.lit(False), F.lit("CLEAR_AWARDED"), F.lit(True)))
    assert (after["category"], after["active"], after["review"]) == ("CLEAR_AWARDED", False, True)


@pytest.mark.parametrize(
    ("display", "amount", "days", "awardee", "want"),
    [("open", 20000.0, 20, "", "good"), ("open", 20000.0, 20, "X", "medium"), ("open", 2000.0, 20, "", "bad"), ("open", 0.0, 9, "", "bad"), ("open", None, None, None, "medium"), ("desierta", 20000.0, 20, "", "bad"), ("ev", 20000.0, 20, "", "unknown")],
)
def test_traffic_light(spark, display, amount, days, awardee, want):
    got = one(spark, N.traffic_light(F.lit(display), F.lit(amount).cast("double"), F.lit(days).cast("int"), F.lit(awardee).cast("string")))
    assert got == want
