"""All fields of a notice's text in one projection: each text becomes an array of lines, each field an expression over it.

No row moves and no text is cut into rows: a field's anchors are the lines with its heading,
its blocks (lots, criteria, deadlines, codes) the lines behind an anchor up to the next one.
Work and memory for a row grow with its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.notices import let
from ..functions.semantics import fold_accents, fold_plain
from . import appendix_tables as T
from . import gates
from .fields import DEADLINES, HEADINGS

EXCERPT = 350
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
_MARKER = r"(?m)^[^\S\r\n]*---\s*PAGE\s+([0-9]+)\s*---[^\S\r\n]*$"
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"

Lines = Column
Test = Callable[[Column], Column]


def line_array(text: Column) -> Lines:
    """The lines of a text that are not blank, in order: (page, raw, fold). The page is that of the last marker line above, 1 before the first."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, _MARKER)
    numbers = F.transform(F.concat(F.array(F.lit("1")), F.regexp_extract_all(text, F.lit(_MARKER), F.lit(1))), lambda n: n.try_cast("int"))
    of_page = lambda part, number: F.transform(F.split(part, _BREAK), lambda raw: F.struct(number.alias("page"), raw.alias("raw"), fold_plain(raw).alias("fold")))
    lines = F.flatten(F.transform(F.arrays_zip(parts.alias("part"), numbers.alias("number")), lambda p: of_page(p["part"], p["number"])))
    return F.filter(lines, lambda x: F.ltrim(x["raw"], F.lit(_SPACES)) != "")


def clean(c: Column) -> Column:
    """Glyph numbers and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\(cid:[0-9]+\)", " "), r"(?U)\s+", " "))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group that matches no empty text matches, null if nothing."""
    return let(F.regexp_extract(text, pattern, group), lambda found: F.when(found != "", found))


def _amount(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def _iso(day: Column) -> Column:
    return F.regexp_replace(day, r"(\d{2})/(\d{2})/(\d{4})", "$3-$2-$1")


def _at(lines: Lines, test: Test) -> Column:
    """The places (from 0) of the lines that pass."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _held(lines: Lines, folded: Column, *needles: str) -> Lines:
    """The lines if the folded ones, joined, have one of the needles, else none."""
    some = F.contains(folded, F.lit(needles[0]))
    for needle in needles[1:]:
        some = some | F.contains(folded, F.lit(needle))
    return F.when(some, lines).otherwise(F.slice(lines, 1, 0))


def _behind(lines: Lines, at: Column, most: int) -> Lines:
    return F.slice(lines, at + 2, F.lit(most))


def _from(lines: Lines, at: Column, most: int) -> Lines:
    return F.slice(lines, at + 1, F.lit(most))


def _until(lines: Lines, stop: Test) -> Lines:
    """The lines before the first that passes."""

    def cut(some: Lines) -> Lines:
        at = F.array_position(F.transform(some, lambda x: F.coalesce(stop(x), F.lit(False))), F.lit(True)).cast("int")
        return let(at, lambda n: F.when(n > 0, F.slice(some, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(some))

    return let(lines, cut)


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _some(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _raws(lines: Lines, between: str = " ") -> Column:
    return F.array_join(F.transform(lines, lambda x: F.trim(x["raw"], F.lit(_SPACES))), between)


def _starts(*prefixes: str) -> Test:
    def test(x: Column) -> Column:
        found = [F.startswith(x["fold"], F.lit(p)) for p in prefixes]
        out = found[0]
        for f in found[1:]:
            out = out | f
        return out

    return test


_heading = _starts(*HEADINGS)


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _field(name: str, value: Column, confidence: str | Column, status: str | Column, page: Column, evidence: Column, method: str = "keyword_window", missing: str = "absent", found: Column | None = None, valued: Column | bool = True, brief: bool = False) -> Column:
    """The struct of a field; without evidence it is missing.

    found says the same as the evidence at less cost, valued whether a field that is found has a value;
    a brief struct has true for the value and neither evidence nor its place.
    """
    literal = lambda x: F.lit(x) if isinstance(x, str) else x
    found = evidence.isNotNull() if found is None else found
    stated = F.when(found, literal(status)).otherwise(missing).alias("field_status")
    if brief:
        return F.struct(F.lit(name).alias("field"), F.when(found & valued, True).alias("value"), stated)
    return F.struct(
        F.lit(name).alias("field"), F.when(found, value).alias("value"), F.when(found, literal(confidence)).alias("confidence"), stated,
        F.lit(method).alias("method"), F.when(found, page).alias("page"), F.left(clean(evidence), F.lit(EXCERPT)).alias("evidence"),
    )


def subject(lines: Lines, folded: Column, brief: bool = False) -> Column:
    """The text behind its heading and in up to 4 lines before the next heading; else the title of the first page."""

    def titled(i: Column) -> Column:
        own = F.regexp_extract(F.get(lines, i)["raw"], r"(?s)^[^:]*:(.*)$", 1)
        return F.struct(clean(F.concat_ws(" ", own, _raws(_until(_behind(lines, i, 4), _heading)))).alias("value"), F.get(lines, i)["page"].alias("page"))

    def title(i: Column) -> Column:
        return F.struct(F.nullif(clean(_raws(_until(_behind(lines, i, 5), _starts("contrato sujeto a regulacion")))), F.lit("")).alias("value"), F.get(lines, i + 1)["page"].alias("page"))

    direct = _first(F.filter(F.transform(_at(_held(lines, folded, "objeto del contrato:"), _starts("objeto del contrato:")), titled), lambda x: x["value"] != ""))
    published = let(_first(_at(_held(lines, folded, "publicado en la plataforma"), _starts("publicado en la plataforma"))), title)

    def shown(x: Column) -> Column:
        own, found = x["own"].isNotNull(), F.coalesce(x["own"], x["title"])
        evidence = F.when(own, F.concat(F.lit("Objeto del Contrato: "), found["value"])).otherwise(found["value"])
        return _field("objeto", found["value"], F.when(own, "high").otherwise("medium"), F.when(own, "extracted").otherwise("partial"), found["page"], evidence, "heading_window", found=found["value"].isNotNull(), brief=brief)

    return let(F.struct(direct.alias("own"), published.alias("title")), shown)


def codes(lines: Lines, folded: Column, brief: bool = False) -> Column:
    """Classification codes with labels in the lines behind their headings, each code once."""
    shape = r"^\s*([0-9]{8})\s*-\s*(.+?)\.?\s*$"
    block = lambda i: F.filter(_until(_behind(lines, i, 11), lambda x: ~x["raw"].rlike(r"^\s*[0-9]")), lambda x: x["raw"].rlike(shape))
    code = lambda x: F.struct(F.regexp_extract(x["raw"], shape, 1).alias("code"), clean(F.regexp_extract(x["raw"], shape, 2)).alias("label"), x["raw"].alias("raw"), x["page"].alias("page"))

    def once(found: Column) -> Column:
        return let(F.transform(found, lambda x: x["code"]), lambda names: F.filter(found, lambda x, i: F.array_position(names, x["code"]) == i + 1))

    def shown(found: Column) -> Column:
        value = _json(F.transform(found, lambda x: F.struct(x["code"].alias("code"), x["label"].alias("label"))))
        return _field("cpv", value, "high", "extracted", _first(found)["page"], F.when(F.size(found) > 0, F.concat(F.lit("Categorias/CPV\n"), _raws(F.slice(found, 1, 6), "\n"))), found=F.size(found) > 0, brief=brief)

    every = F.flatten(F.transform(_at(_held(lines, folded, "categorias/cpv", "clasificacion cpv"), _starts("categorias/cpv", "clasificacion cpv")), lambda i: F.transform(block(i), code)))
    return let(let(every, once), shown)


_WORTH = r"valor estimado del contrato\s+([\d.,]+)\s*eur"


def _worth(x: Column) -> Column:
    return F.when(F.contains(x["fold"], F.lit("valor estimado")), _part(x["fold"], _WORTH))


def estimated_value(lines: Lines, folded: Column, brief: bool = False) -> Column:
    amount = lambda x: _amount(F.when(F.contains(x["fold"], F.lit("valor estimado")), F.regexp_extract(x["fold"], _WORTH, 1)))
    shown = lambda x: _field("valor_estimado", _json(F.struct(amount(x).alias("amount"), F.lit("EUR").alias("currency"))), "high", "extracted", x["page"], x["raw"], "regex", brief=brief)
    return let(_first(F.filter(_held(lines, folded, "valor estimado"), lambda x: amount(x).isNotNull())), shown)


def base_budget(lines: Lines, folded: Column, brief: bool = False) -> Column:
    """The amounts with and without taxes in the 4 lines behind the heading; the first heading with either."""
    net = lambda x: _part(x["fold"], r"importe\s*\(sin impuestos\)\s+([\d.,]+)\s*eur")
    gross = lambda x: F.when(~F.contains(x["fold"], F.lit("sin impuestos")), _part(x["fold"], r"importe\s+([\d.,]+)\s*eur"))
    last = lambda items: F.get(items, F.size(items) - 1)

    def amounts(i: Column) -> Column:
        def of(block: Column) -> Column:
            return F.struct(
                _amount(last(_some(F.transform(block, lambda x: x["gross"])))).alias("gross"), _amount(last(_some(F.transform(block, lambda x: x["net"])))).alias("net"), F.get(lines, i)["page"].alias("page"),
                F.concat_ws("\n", F.get(lines, i)["raw"], _raws(F.slice(F.filter(block, lambda x: x["net"].isNotNull() | x["gross"].isNotNull()), 1, 3), "\n")).alias("seen"),
            )

        read = F.transform(_behind(lines, i, 4), lambda x: F.struct(net(x).alias("net"), gross(x).alias("gross"), x["raw"].alias("raw"), _heading(x).alias("heading")))
        return let(_until(read, lambda x: x["net"].isNull() & x["gross"].isNull() & x["heading"]), of)

    def shown(x: Column) -> Column:
        value = F.struct(x["gross"].alias("importe_con_impuestos"), x["net"].alias("importe_sin_impuestos"), F.lit("EUR").alias("currency"))
        return _field("presupuesto_base", _json(value), "medium", "partial", x["page"], x["seen"], brief=brief)

    return let(_first(F.filter(F.transform(_at(_held(lines, folded, "presupuesto base de licitacion"), _starts("presupuesto base de licitacion")), amounts), lambda x: x["gross"].isNotNull() | x["net"].isNotNull())), shown)


def duration(lines: Lines, folded: Column, brief: bool = False) -> Column:
    """The first and last day in the heading's line or the 3 behind it, with remarks."""
    span = r"del\s+(\d{2}/\d{2}/\d{4})\s+al\s+(\d{2}/\d{2}/\d{4})"
    dated = lambda i: _first(F.filter(F.transform(_from(lines, i, 4), lambda x, j: F.when(x["fold"].rlike(span), i + j)), lambda j: j.isNotNull()))
    pairs = F.transform(_at(_held(lines, folded, "plazo de ejecucion"), lambda x: F.contains(x["fold"], F.lit("plazo de ejecucion"))), lambda i: F.struct(i.alias("i"), dated(i).alias("j")))
    note = lambda j: _first(F.filter(_until(_behind(lines, j, 3), lambda x: _heading(x) & ~_starts("observaciones:")(x)), _starts("observaciones:")))["raw"]

    def read(x: Column) -> Column:
        line = F.get(lines, x["j"])
        return F.when(x.isNotNull(), F.struct(F.get(lines, x["i"]).alias("head"), line["fold"].alias("fold"), line["raw"].alias("raw"), note(x["j"]).alias("note")))

    def shown(x: Column) -> Column:
        value = F.struct(_iso(_part(x["fold"], span, 1)).alias("desde"), _iso(_part(x["fold"], span, 2)).alias("hasta"), clean(F.regexp_extract(x["note"], r"(?s)^[^:]*:(.*)$", 1)).alias("observaciones"))
        return _field("duracion", _json(value), "high", "extracted", x["head"]["page"], F.when(x.isNotNull(), F.concat_ws("\n", x["head"]["raw"], x["raw"], x["note"])), found=x.isNotNull(), brief=brief)

    return let(let(_first(F.filter(pairs, lambda x: x["j"].isNotNull())), read), shown)


_LOT = r"^lote\s+(\d+):\s*(.+)$"


def _is_lot(x: Column) -> Column:
    return F.startswith(x["fold"], F.lit("lote")) & x["fold"].rlike(_LOT)


def lots(lines: Lines, folded: Column, brief: bool = False) -> Column:
    """Lots: number, description and the value in up to 7 lines before the next lot; their number alone is no value."""

    def lot(i: Column, worths: Column) -> Column:
        line = F.get(lines, i)
        worth = _first(_some(F.transform(_until(_behind(worths, i, 7), lambda x: x["lot"] & x["worth"].isNull()), lambda x: x["worth"])))
        return F.struct(_part(line["fold"], _LOT).try_cast("int").alias("num"), clean(F.regexp_extract(line["raw"], r"(?s)^[^:]*:(.*)$", 1)).alias("descripcion"), _amount(worth).alias("valor_estimado"))

    def shown(x: Column) -> Column:
        found, counted = x["found"], x["counted"]
        some = F.size(found) > 0
        names = F.transform(F.slice(found, 1, 4), lambda y: F.concat(F.lit("Lote "), y["num"].cast("string"), F.lit(": "), F.left(y["descripcion"], F.lit(60))))
        seen = F.concat_ws("\n", F.trim(counted["raw"]), F.array_join(names, "\n"))
        told = some | counted.isNotNull()
        return _field("lotes", F.when(some, _json(found)), F.when(some, "medium").otherwise("low"), "partial", F.coalesce(counted["page"], F.lit(1)), F.when(told, seen), found=told, valued=some, brief=brief)

    held = _held(lines, folded, "lote")
    counted = _first(F.filter(_held(lines, folded, "de lotes:"), lambda x: x["fold"].rlike(r"de lotes:\s*\d+")))
    if brief:
        found = F.filter(held, _is_lot)
    else:  # each line is read once, not once for each lot above it
        read = F.transform(held, lambda x: F.struct(_is_lot(x).alias("lot"), _worth(x).alias("worth")))
        found = let(read, lambda worths: F.transform(_at(worths, lambda x: x["lot"]), lambda i: lot(i, worths)))
    return let(F.struct(found.alias("found"), counted.alias("counted")), shown)


def deadlines(lines: Lines, folded: Column, brief: bool = False) -> Column:
    """Deadlines of the known kinds, each once, and the time that offers stay valid."""
    until = r"hasta el\s+(\d{2}/\d{2}/\d{4})\s+a las\s+(\d{2}:\d{2})"
    nothing = F.lit(None).cast("string")

    def kind(x: Column) -> Column:
        out = nothing
        for prefix, name in reversed(DEADLINES.items()):
            out = F.when(F.startswith(x["fold"], F.lit(prefix)), F.lit(name)).otherwise(out)
        return out

    def one(tipo: Column, day: Column, hour: Column, raw: Column) -> Column:
        return F.struct(tipo.alias("tipo"), day.alias("fecha_limite"), hour.alias("hora"), raw.alias("raw"))

    def dated(i: Column) -> Column:
        stated = lambda x: F.when(x.isNotNull(), one(kind(F.get(lines, i)), _iso(_part(x["fold"], until, 1)), _part(x["fold"], until, 2), nothing))
        return let(_first(F.filter(_from(lines, i, 4), lambda x: x["fold"].rlike(until))), stated)

    def valid(i: Column) -> Column:
        stated = lambda x: F.when(x.isNotNull(), one(F.lit("validez_oferta"), nothing, nothing, clean(x["raw"])))
        return let(_first(F.filter(_behind(lines, i, 2), lambda x: x["fold"].rlike(r"^\d+\s*mes"))), stated)

    def shown(found: Column) -> Column:
        seen = F.array_join(F.transform(F.slice(found, 1, 6), lambda x: F.concat_ws(" -> ", x["tipo"], x["fecha_limite"], x["hora"], x["raw"])), "\n")
        return _field("plazos", _json(found), "medium", "extracted", _first(lines)["page"], F.when(F.size(found) > 0, seen), found=F.size(found) > 0, brief=brief)

    dates = F.array_distinct(_some(F.transform(_at(_held(lines, folded, *DEADLINES), _starts(*DEADLINES)), dated)))
    return let(F.concat(dates, _some(F.transform(_at(_held(lines, folded, "plazo de validez de la oferta"), _starts("plazo de validez de la oferta")), valid))), shown)


def criteria(lines: Lines, folded: Column, brief: bool = False) -> Column:
    """Award criteria, as an array of three fields: all, the weight of the price, and the technical ones that have a name."""

    def usable(x: Column) -> Column:
        return ~_starts(*T.NO_CRITERION)(x) & ~F.contains(x["fold"], F.lit("no tiene criterios"))

    def criterion(i: Column) -> Column:
        above = F.reverse(F.slice(lines, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))))
        weight = _first(_some(F.transform(_behind(lines, i, 2), lambda x: _part(x["fold"], r"ponderacion\s*:\s*(\d+)"))))
        price = F.get(lines, i)["fold"].rlike(r"^subtipo criterio\s*:\s*precio")
        name = F.coalesce(clean(_first(F.filter(above, usable))["raw"]), F.when(price, "Precio"))
        return F.struct(name.alias("nombre"), F.when(price, "Precio").otherwise("Otros").alias("subtipo"), weight.try_cast("int").alias("ponderacion"), F.get(lines, i)["page"].alias("page"))

    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def shown(x: Column) -> Column:
        found, page, seen = x["found"], _first(x["found"])["page"], x["seen"]
        price = _first(F.filter(found, lambda y: y["subtipo"] == "Precio"))
        other = F.transform(F.filter(found, lambda y: (y["subtipo"] == "Otros") & (y["nombre"] != "")), lambda y: F.struct(y["nombre"].alias("nombre"), y["ponderacion"].alias("ponderacion")))
        every = F.transform(found, lambda y: F.struct(y["nombre"].alias("nombre"), y["subtipo"].alias("subtipo"), y["ponderacion"].alias("ponderacion")))
        return F.array(
            _field("criterios_adjudicacion", _json(every), "medium", "extracted", page, F.when(F.size(found) > 0, seen), found=F.size(found) > 0, brief=brief),
            _field("criterios_precio", _json(F.struct(price["ponderacion"].alias("ponderacion"))), "medium", "extracted", page, F.when(price.isNotNull(), seen), found=price.isNotNull(), brief=brief),
            _field("criterios_tecnicos", _json(other), "low", "partial", page, F.when(F.size(other) > 0, seen), found=F.size(other) > 0, brief=brief),
        )

    def described(found: Column) -> Column:
        names = F.transform(F.slice(found, 1, 6), lambda y: F.concat(text(y["nombre"]), F.lit(" / Subtipo: "), y["subtipo"], F.lit(" / Ponderacion: "), text(y["ponderacion"])))
        return F.struct(found.alias("found"), F.array_join(names, "\n").alias("seen"))

    every = F.transform(_at(_held(lines, folded, "subtipo criterio"), lambda x: F.startswith(x["fold"], F.lit("subtipo")) & x["fold"].rlike(r"^subtipo criterio\s*:\s*(precio|otros)")), criterion)
    return let(let(every, described), shown)


def _across(folded: Column, text: Column, needle: str, use: Callable[[Column], Column]) -> Column:
    """use of a whole text's fold, whose matches may cross lines and page marks; null if no line has the needle they begin with."""
    return F.when(F.contains(folded, F.lit(needle)), use(fold_accents(text)))


def contract_data(lines: Lines, folded: Column, whole: Column, brief: bool = False) -> Column:
    """(value, procedure, seen, page; if brief, seen alone): file number, procedure, handling, contracting system, way of offering, directive."""
    line = lambda prefix: _first(F.filter(_held(lines, folded, prefix), _starts(prefix)))
    stated = F.struct(line("numero de expediente").alias("num_expediente"), *(line(p).alias(n) for n, p in T.CONTRACT.items()), F.upper(_across(folded, whole, "directiva", lambda f: _part(f, r"directiva\s+(20\d{2}/\d+/[a-z]+)"))).alias("directiva"))

    def shown(x: Column) -> Column:
        rest = {n: F.nullif(clean(F.substring(x[n]["raw"], len(p), 2147483647)), F.lit("")) for n, p in T.CONTRACT.items()}
        data = {"num_expediente": clean(F.regexp_replace(x["num_expediente"]["raw"], r"(?i)^n[uú]mero de expediente\s+", "")), **rest, "directiva": x["directiva"]}
        seen = F.concat_ws("\n", *(F.trim(x[n]["raw"]) for n in ("num_expediente", *T.CONTRACT)))
        told = F.when(F.coalesce(*data.values()).isNotNull(), seen).alias("seen")
        if brief:
            return F.struct(told)
        return F.struct(
            F.to_json(F.struct(*(c.alias(n) for n, c in data.items()))).alias("value"), data["procedimiento"].alias("procedure"), told,
            F.coalesce(x["num_expediente"]["page"], F.lit(1)).alias("page"),
        )

    return let(stated, shown)


def solvency(lines: Lines, folded: Column, name: str, heading: str, brief: bool = False) -> Column:
    """The lines at a heading of solvency, as evidence only: a notice mostly points at the tender documents."""

    def read(at: Column) -> Column:
        window = F.concat(_from(lines, at, 1), _until(_behind(lines, at, 2), _starts("criterio de solvencia", "preparacion de oferta")))
        return F.struct(F.when(at.isNotNull(), _raws(window)).alias("text"), F.get(lines, at)["page"].alias("page"))

    def shown(x: Column) -> Column:
        points = fold_accents(x["text"]).rlike("|".join(T.POINTERS))
        return _field(name, F.lit(None).cast("string"), "low", F.when(points, "deferred_to_pcap").otherwise("evidence_only"), x["page"], x["text"], valued=False, brief=brief)

    return let(let(_first(_at(_held(lines, folded, heading), _starts(heading))), read), shown)


def opportunity(lines: Lines, folded: Column, whole: Column, procedure: Column, deadline_valid: Column, brief: bool = False) -> Column:
    """Flags: dynamic purchasing system, restricted procedure, harmonised rules, EU funds, number of lots, valid deadline."""
    restricted = F.contains(fold_accents(F.coalesce(procedure, F.lit(""))), F.lit("restringido"))
    funds = F.when(F.contains(folded, F.lit("no hay financiacion con fondos de la ue")), False).when(F.contains(folded, F.lit("fondos de la ue")) | F.contains(folded, F.lit("fondos ue")), True)
    counted = let(F.size(F.filter(_held(lines, folded, "lote"), _is_lot)), lambda n: F.when(n > 0, n).otherwise(_across(folded, whole, "de lotes:", lambda f: _part(f, r"de lotes:\s*(\d+)").try_cast("int"))))
    if brief:  # every text has them
        return _field("opportunity_flags", F.lit(None), "high", "extracted", F.lit(1), F.lit(""), found=F.lit(True), brief=True)
    value = F.struct(
        F.contains(folded, F.lit("sistema dinamico de adquisicion")).alias("es_sda"), restricted.alias("procedimiento_restringido"),
        F.coalesce(_across(folded, whole, "contrato sujeto a regulacion armonizada", lambda f: F.regexp_extract(f, r"contrato sujeto a regulacion armonizada\s+(si|no)", 1) == "si"), F.lit(False)).alias("sujeto_regulacion_armonizada"), funds.alias("fondos_ue"),
        counted.alias("num_lotes"), F.coalesce(deadline_valid, F.lit(False)).alias("deadline_valid"),
    )
    told = F.filter(F.slice(_held(lines, folded, "regulacion armonizada", "sistema de contratacion"), 1, 30), lambda x: F.contains(x["fold"], F.lit("regulacion armonizada")) | F.contains(x["fold"], F.lit("sistema de contratacion")))
    seen = F.coalesce(F.nullif(_raws(F.slice(told, 1, 4), "\n"), F.lit("")), _first(lines)["raw"], F.lit(""))
    return let(F.struct(value.alias("value"), seen.alias("seen")), lambda x: _field("opportunity_flags", _json(x["value"]), "high", "extracted", F.lit(1), x["seen"], "derived"))


def document_role(lines: Lines, folded: Column) -> Column:
    """(role, confidence, evidence) of a document by what its text says."""
    header = F.array_join(F.transform(F.slice(lines, 1, 3), lambda x: x["fold"]), " ")
    holds = lambda *words: F.contains(folded, F.lit(words[0])) if len(words) == 1 else F.contains(folded, F.lit(words[0])) | holds(*words[1:])
    line = lambda needle: F.coalesce(_first(F.filter(lines, lambda x: F.contains(x["fold"], F.lit(needle))))["raw"], F.lit(""))
    is_ = lambda role, confidence, evidence: F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), F.left(clean(evidence), F.lit(EXCERPT)).alias("evidence"))
    notice = holds("anuncio de licitacion") & holds("numero de expediente") & holds("plataforma de contratacion", "sello de tiempo")
    return (
        F.when(F.contains(header, F.lit("documento de pliegos")), is_("documento_pliegos", "high", line("documento de pliegos")))
        .when(F.startswith(header, F.lit("anuncio previo")), is_("anuncio_previo", "high", line("anuncio previo")))
        .when(notice, is_("anuncio_placsp", "high", _raws(F.slice(lines, 1, 6), "\n")))
        .when(holds("pliego de clausulas administrativas particulares"), is_("pcap", "high", line("pliego de clausulas administrativas")))
        .when(holds("pliego de prescripciones tecnicas"), is_("ppt", "high", line("pliego de prescripciones tecnicas")))
        .when(holds("acta de adjudicacion", "acta de formalizacion", "formalizacion del contrato"), is_("acta", "medium", line("acta")))
        .otherwise(is_("unknown", "low", F.coalesce(F.get(lines, F.lit(0))["raw"], F.lit(""))))
    )


def notice_fields(docs: DataFrame, ident: list[str], text: str, deadline_valid: Column | None = None, brief: bool = False) -> DataFrame:
    """(ident..., field, value, confidence, field_status, method, page, evidence): the 18 fields of each text, one row a field.

    Composite values are JSON. Fields that only tender documents have are "deferred", those
    not found "absent"; solvency has evidence and never a value. A null or blank text has
    the flags, all unset, and else no field. Brief rows (ident..., field, value, field_status) say by
    true or null whether a field has a value, without reading what it is.
    """
    valid = F.lit(False) if deadline_valid is None else deadline_valid
    rows = docs.select(*ident, valid.alias("_valid"), F.coalesce(F.col(text), F.lit("")).alias("_text"), line_array(F.col(text)).alias("_lines"))
    lines, folded, whole, contract = F.col("_lines"), F.col("_folded"), F.col("_text"), F.col("_contract")
    rows = rows.withColumn("_folded", F.array_join(F.transform(lines, lambda x: x["fold"]), "\n"))
    rows = rows.withColumn("_contract", contract_data(lines, folded, whole, brief))
    nothing, no_page = F.lit(None).cast("string"), F.lit(None).cast("int")
    found = [
        *(f(lines, folded, brief) for f in (subject, codes, estimated_value, base_budget, duration, lots, deadlines)),
        _field("contract_meta", contract["value"], "high", "extracted", contract["page"], contract["seen"], "regex", brief=brief),
        solvency(lines, folded, "solvencia_economica", "criterio de solvencia economica", brief), solvency(lines, folded, "solvencia_tecnica", "criterio de solvencia tecnica", brief),
        opportunity(lines, folded, whole, contract["procedure"], F.col("_valid"), brief),
        *(_field(f, nothing, nothing, "deferred", no_page, nothing, "manual_later", "deferred", brief=brief) for f in T.DEFERRED),
    ]
    return rows.select(*ident, F.explode(F.concat(F.array(*found), criteria(lines, folded, brief))).alias("f")).select(*ident, "f.*")


def appendix_status(found: DataFrame, ident: list[str]) -> DataFrame:
    """(ident..., coverage, appendix_status) of notice_fields, brief or not; a field that is left to the tender documents keeps a notice from being ready."""
    left = F.col("field").isin(*T.DEFERRED, *T.EVIDENCE_ONLY) & F.col("field_status").isin("deferred", "deferred_to_pcap", "evidence_only")
    sums = found.groupBy(*ident).agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("field"))).alias("present"), (F.count_if(left) > 0).alias("left"))
    counted = F.size(F.array_intersect("present", F.array(*map(F.lit, T.NOTICE))))
    status = gates.appendix_status(F.lit(True), F.lit("anuncio_placsp"), F.col("present"), F.col("left"))
    return sums.select(*ident, F.round(counted / len(T.NOTICE), 3).alias("coverage"), status.alias("appendix_status"))
