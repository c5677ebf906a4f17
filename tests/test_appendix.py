"""Fields of tender documents against a direct reading of each text, and the status of records."""

import random
import re

import pytest

from pliego.operators import appendix as A
from pliego.operators import appendix_tables as T

PROSE = "el licitador deberá acreditar ante el órgano de contratación los medios que se indican a continuación con la documentación que corresponda en cada caso"
FOLD = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy")


def fold(s):
    return " ".join(s.lower().translate(FOLD).split())


def section(line):
    s = line.strip()
    if not s or len(s) > 130:
        return False
    letters = [c for c in s if c.isalpha()]
    shaped = re.match(r"\s*\d{1,2}(\.\d{1,2})*\s*[.\-)]?\s+\S", line) or re.match(r"[A-Z]\.?\s*\d{0,2}\.?\s+[A-ZÁÉÍÓÚÑ]", s) or re.match(r"[A-Z][).]\s+\S", s)
    return bool(shaped) or len(letters) >= 4 and sum(c.upper() == c for c in letters) >= 0.7 * len(letters)


def direct(text, variants, size):
    """The best window of each field, line by line."""
    lines, page = [], 0
    for raw in (text or "").splitlines():
        mark = re.match(r"---\s*PAGE\s+(\d+)\s*---$", raw.strip(), re.I)
        if mark:
            page = int(mark[1])
        else:
            lines.append((raw, page or 1))
    leader = [bool(re.search(r"\.{4,}", raw) or re.search(r"\.{2,}\s*\d{1,4}$", raw.strip())) for raw, _ in lines]
    out = {}
    for field, names in variants.items():
        hits = []
        for i, (raw, p) in enumerate(lines):
            norm = fold(raw)
            at = [(norm.find(v), v) for v in names]
            if not any(k >= 0 and not norm[k - 1 : k].isalnum() * (k > 0) and not norm[k + len(v) : k + len(v) + 1].isalnum() for k, v in at):
                continue
            following = next((j for j in range(i + 1, len(lines)) if lines[j][0].strip()), None)
            contents = leader[i] or following is not None and leader[following]
            body = []
            for j in range(i + 1, len(lines)):
                if section(lines[j][0]):
                    break
                body.append(lines[j][0])
            joined = "\n".join(body)
            rest = joined[:size].strip()
            window = f"{raw.strip()}\n{rest}" if rest else raw.strip()
            score = 0 if contents else len(window) - window.count(".") + 400 * section(raw)
            hits.append(((not contents, score, -i), contents, section(raw), p, raw.strip(), window, bool(body) and len(joined) + 1 > size))
        if not hits:
            continue
        _, contents, head, p, line, window, cut = max(hits)
        letters = sum(c.isalpha() for c in window)
        pointer = contents or letters < 25 or window.count(".") >= 20 and letters < 0.45 * len(window)
        label = re.sub(r"\.{2,}.*$", "", line).strip()
        shown = label if pointer else window
        confidence = "low" if pointer else "high" if head and len(window) > 200 else "medium" if len(window) > 120 else "low"
        out[field] = (shown[: A.VALUE], shown, p, (label if pointer else line)[: A.HEADING], "heading_window" if pointer or head else "keyword_window", confidence, pointer, not pointer and (cut or len(window) > A.VALUE))
    return out


def made(seed):
    r = random.Random(seed)
    names = [v for vs in T.VARIANTS.values() for v in vs]
    lines = []
    for _ in range(r.choice([0, 3, 10, 40])):
        name = r.choice(names)
        lines.append(
            r.choice([
                "", "   ", PROSE[: r.randint(0, len(PROSE))], PROSE, f"{r.randint(1, 30)}. {name.capitalize()}", name.upper(), f"el {name} del contrato", f"x{name}", f"{name}s", f"{name} ........ {r.randint(1, 90)}", f"{name}.. 7",
                f"--- PAGE {r.randint(0, 9)} ---", " --- page 12 --- ", "A) Otros datos", "solvencia  económica", "Á. É", "." * 30, "OBJETO DEL CONTRATO\x0bfin", PROSE * 3,
            ])
        )
    return r.choice(["\n", "\r\n"]).join(lines)


@pytest.mark.parametrize("size", [A.WINDOW, 200, 30])
def test_windows_as_read_directly(spark, size):
    texts = [made(seed) for seed in range(120)] + [None, "", "objeto del contrato", "lotes\n" * 300, "1. Lotes\n" + "\n" * 500 + PROSE, "lotes " + PROSE * 40, f"LOTES\n{PROSE * 40}\nfin"]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, t string").repartition(3)
    got = {(r["d"], r["field"]): tuple(r)[2:] for r in A.field_windows(df, "d", "t", window=size).collect()}
    assert got == {(d, f): x for d, t in enumerate(texts) for f, x in direct(t, T.VARIANTS, size).items()}


@pytest.mark.parametrize("field", T.VARIANTS)
def test_each_field_by_each_heading(spark, field):
    texts = [(k, f"ANEXO\n{k + 1}. {v.capitalize()}:\n{PROSE}\n{PROSE}\n9. Fin\n") for k, v in enumerate(T.VARIANTS[field])]
    found = A.field_windows(spark.createDataFrame(texts, "d int, t string"), "d", "t", {field: T.VARIANTS[field]}).collect()
    assert {(r["d"], r["field"], r["confidence"], r["method"]) for r in found} == {(k, field, "high", "heading_window") for k, _ in texts}
    assert all(r["value"].endswith(PROSE) and "Fin" not in r["value"] for r in found)


def test_classification_codes(spark):
    texts = [(1, "x\nCódigo CPV:\n 79340000-9 Publicidad\n"), (2, "cpv 7934"), (3, "xcpv 79340000"), (4, None), (5, "CPV79340000")]
    found = A.classification_code(spark.createDataFrame(texts, "d int, t string"), "d", "t").collect()
    assert [(r["d"], r["value"], r["excerpt"]) for r in found] == [(1, "79340000-9", "79340000-9 Publicidad")]


DOC = "r string, position int, role string, text string, chars int, pages int, url string, final_url string, label string"
FULL = "\n".join(f"{k}. {T.VARIANTS[f][0].capitalize()}\n{PROSE}\n{PROSE}" for k, f in enumerate(T.CORE, 1))


@pytest.fixture(scope="module")
def records(spark):
    def doc(r, position, role, text, pages=2, **more):
        return (r, position, role, text, more.get("chars", len(text or "")), pages, more.get("url", f"u{position}"), None, more.get("label"))

    docs = [
        doc("full", 1, "pcap", FULL), doc("full", 2, "ppt", "1. Alcance\n" + PROSE), doc("full", 3, "pcap", FULL.replace("ante", "frente a")),
        doc("half", 1, "pcap", "1. Objeto del contrato\n" + PROSE), doc("half", 2, "ppt", "", chars=0), doc("links", 1, "ppt", "nada", url=""), doc("links", 2, "pcap", "nada", label="El pliego"),
        doc("scan", 1, "pcap", "x" * 200, pages=40), doc("lost", 1, "ppt", None), doc("other", 1, "acta", FULL), doc("index", 1, "pcap", "1. Lotes ........ 4"), doc("role", 1, "ppt", "1. Penalidades\n" + PROSE),
    ]
    fields, status = A.record_fields(spark.createDataFrame(docs, DOC), "r")
    return {(r["r"], r["field"]): r for r in fields.collect()}, {r["r"]: r for r in status.collect()}


def test_record_status(records):
    _, status = records
    assert {r: (x["record_status"], x["badge"], x["fields_extracted"], x["show_fields"], x["manual_review"], x["ocr_needed"]) for r, x in status.items()} == {
        "full": ("parsed", "parsed", 9, True, False, False), "half": ("partial", "partial", 1, True, True, True), "links": ("source_link_only", "source_link_only", 0, False, True, False),
        "scan": ("ocr_needed", "ocr_needed", 0, False, False, True), "lost": ("failed", "source_link_only", 0, False, True, True), "other": ("failed", "source_link_only", 0, False, True, False),
        "index": ("partial", "partial", 1, True, True, False), "role": ("source_link_only", "source_link_only", 0, False, True, False),
    }
    assert {r: x["message"] for r, x in status.items()} == {r: T.MESSAGES[m] for r, m in {"full": "parsed", "half": "partial_ocr", "links": "source_link_only", "scan": "ocr_needed", "lost": "failed", "other": "failed", "index": "partial", "role": "source_link_only"}.items()}
    assert {r: x["warnings"] for r, x in status.items() if r in ("full", "half", "scan", "index", "links")} == {
        "full": [], "half": ["ocr_needed"], "scan": ["field_not_found", "manual_review_recommended", "ocr_needed", "text_low_coverage"], "index": ["only_pointer_found"], "links": ["field_not_found", "manual_review_recommended"],
    }


def test_record_fields(records):
    fields, _ = records
    assert len({f for _, f in fields}) == 30 and len(fields) == 30 * 8
    assert (fields["full", "objeto"]["position"], fields["full", "objeto"]["field_status"], fields["full", "objeto"]["fallback"]) == (1, "extracted", None)
    assert fields["full", "alcance_tecnico"]["position"] == 2 and fields["index", "lotes"]["field_status"] == "evidence_only"
    assert fields["role", "penalidades"]["value"] is None


def test_missing_fields_say_where_to_look(records):
    fields, _ = records
    shown = {r: tuple(fields[r, "entregables"]["fallback"]) for r in ("full", "half", "links", "scan", "lost", "other")}
    ppt, pcap = T.LABELS["ppt"], T.LABELS["pcap"]
    assert shown == {
        "full": ("open_source_document", ppt, "u2", "", T.WHY_MISSING[2]), "half": ("manual_review", ppt, "u2", "", T.WHY_MISSING[1]), "links": ("open_source_document", "El pliego", "u2", "", T.WHY_MISSING[2]),
        "scan": ("ocr_needed", pcap, "u1", "", T.WHY_MISSING[0]), "lost": ("ocr_needed", ppt, "u1", "", T.WHY_MISSING[0]), "other": ("open_source_document", T.ANY_DOCUMENT, "", "", T.WHY_MISSING[2]),
    }
    assert {fields[r, "entregables"]["field_status"] for r in ("scan", "lost")} == {"ocr_needed"} and fields["half", "entregables"]["field_status"] == "manual_review_recommended"
    assert fields["links", "lotes"]["fallback"]["label"] == "El pliego"


def test_lines_move_once(spark):
    df = spark.createDataFrame([(1, "x")], "d int, t string")
    assert A.field_windows(df, "d", "t")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
