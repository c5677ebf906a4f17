"""Fixed values of the tender documents: headings by field, fields by role, labels and messages.

These must agree with published data and are stated as they are, in their natural order.
"""

from __future__ import annotations

#: Headings of each field, in lower case without accents.
VARIANTS = {
    "solvencia_economica": ("solvencia economica", "solvencia economica y financiera", "capacidad economica", "volumen anual de negocios"),
    "solvencia_tecnica": (
        "solvencia tecnica", "solvencia profesional", "solvencia tecnica o profesional", "solvencia tecnica e profesional", "relacion de servicios", "relacion de los principales servicios",
    ),
    "clasificacion_empresarial": ("clasificacion empresarial", "clasificacion del contratista", "clasificacion exigible", "habilitacion empresarial", "clasificacion del empresario"),
    "criterios_adjudicacion": ("criterios de adjudicacion", "criterios de adxudicacion", "criterios evaluables", "criterios de valoracion"),
    "criterios_precio": (
        "criterios automaticos", "criterios cuantificables mediante formulas", "criterios evaluables mediante formulas", "oferta economica", "puntuacion economica", "criterios objetivos",
    ),
    "criterios_tecnicos": ("juicio de valor", "criterios sujetos a juicio de valor", "criterios cualitativos", "criterios tecnicos"),
    "formulas": ("formula", "puntuacion de la oferta economica", "puntuacion economica", "metodo de valoracion"),
    "documentacion_exigida": (
        "documentacion a presentar", "documentacion administrativa", "documentacion exigida", "archivo electronico", "declaracion responsable", "sobre a", "sobre b", "sobre c", "sobre numero", "sobre nº",
    ),
    "garantia_provisional": ("garantia provisional",),
    "garantia_definitiva": ("garantia definitiva", "garantias"),
    "duracion_contrato": ("duracion del contrato", "prazo de duracion", "plazo de duracion", "duracion del sistema", "prazo de vixencia", "plazo de vigencia"),
    "plazo_presentacion": (
        "plazo de presentacion", "prazo de presentacion", "presentacion de ofertas", "presentacion de las ofertas", "presentacion das ofertas", "presentacion de proposiciones",
    ),
    "plazo_ejecucion": ("plazo de ejecucion", "prazo de execucion", "plazo de ejecucion total", "plazo de duracion y prorroga"),
    "penalidades": ("penalidades", "regimen de penalidades", "penalidades por demora", "causas de resolucion del contrato y penalidades"),
    "obligaciones_principales": ("obligaciones del contratista", "obligaciones principales", "condiciones especiales de ejecucion", "obrigas do contratista"),
    "subrogacion_personal": ("subrogacion", "subrogacion del personal", "subrogacion de personal"),
    "lotes": ("division en lotes", "lotes", "division por lotes"),
    "variantes": ("variantes", "mejoras", "admision de variantes"),
    "presupuesto_base": ("presupuesto base", "presupuesto base de licitacion", "orzamento base", "orzamento maximo", "orzamento base de licitacion"),
    "valor_estimado": ("valor estimado", "valor estimado del contrato"),
    "cpv": ("cpv",),
    "objeto": ("objeto del contrato", "objeto y alcance", "definicion del objeto", "definicion do obxecto", "obxecto do sistema", "obxecto", "objeto del sistema"),
    "alcance_tecnico": ("alcance del servicio", "alcance del contrato", "alcance tecnico", "alcance de los trabajos", "alcance"),
    "prescripciones_tecnicas": ("prescripciones tecnicas", "prescricions tecnicas", "prescripciones tecnicas generales"),
    "entregables": ("entregables", "productos entregables"),
    "medios_materiales": ("medios y materiales", "medios materiales", "medios personales y materiales", "adscripcion de medios", "medios materiales y personales"),
    "perfiles_equipo": ("perfiles", "equipo de trabajo", "medios personales", "personal adscrito", "perfiles del equipo"),
    "condiciones_servicio": ("condiciones del servicio", "condiciones de prestacion del servicio", "condiciones de prestacion"),
    "niveles_servicio": ("niveles de servicio", "acuerdo de nivel de servicio", "acuerdos de nivel de servicio"),
    "mantenimiento_soporte": ("mantenimiento y soporte", "mantenimiento", "soporte tecnico"),
}

#: Fields of administrative and of technical documents.
ROLES = {
    "pcap": (
        "solvencia_economica", "solvencia_tecnica", "clasificacion_empresarial", "criterios_adjudicacion", "criterios_precio", "criterios_tecnicos", "formulas", "documentacion_exigida",
        "garantia_provisional", "garantia_definitiva", "duracion_contrato", "plazo_presentacion", "plazo_ejecucion", "penalidades", "obligaciones_principales", "subrogacion_personal",
        "lotes", "variantes", "presupuesto_base", "valor_estimado", "cpv", "objeto",
    ),
    "ppt": (
        "objeto", "alcance_tecnico", "prescripciones_tecnicas", "entregables", "medios_materiales", "perfiles_equipo", "condiciones_servicio", "niveles_servicio", "mantenimiento_soporte",
        "plazo_ejecucion", "cpv",
    ),
}

#: Fields that decide whether a record counts as parsed.
CORE = ("objeto", "solvencia_economica", "solvencia_tecnica", "criterios_adjudicacion", "garantia_definitiva", "plazo_ejecucion", "presupuesto_base", "valor_estimado")

LABELS = {"pcap": "PCAP / Pliego administrativo", "ppt": "PPT / Pliego técnico"}
ANY_DOCUMENT = "Documento del expediente"

#: Why a field is missing: no usable text, some document without, all texts read.
WHY_MISSING = (
    "source text too sparse to locate this field; OCR needed first",
    "field not located in parsed text; one document needs OCR, manual review recommended",
    "field not found in parsed text with conservative rules; open source document to verify",
)

MESSAGES = {
    "parsed": "Structured fields extracted from the pliegos with supporting evidence.",
    "ocr_needed": "Document appears image-based; OCR needed before reliable extraction.",
    "source_link_only": "Could not parse structured fields from this document. Source document link is available.",
    "failed": "No extractable text available; open the source document.",
    "partial_ocr": "Some fields parsed. One document has low text coverage; open source document or run OCR later.",
    "partial": "Some fields parsed; important fields missing. Manual review recommended.",
}

#: Notices: words that only point at the tender documents, lines that are no criterion's name, headings of the contract's data.
POINTERS = (
    "se describe en el pliego", "ver apartado", "ver apartados", "ver pcap", "conforme pliego", "conforme apartado", "conforme ccp", "del pcap", "el pcap", "del ccp", "error plataforma", "no hacer nada",
    "que rige la contratacion",
)
NO_CRITERION = ("subtipo criterio", "ponderacion", "cantidad minima", "cantidad maxima", "criterios de adjudicacion", "criterios evaluables", "condiciones de adjudicacion")
CONTRACT = {"procedimiento": "procedimiento ", "tramitacion": "tramitacion ", "sistema_contratacion": "sistema de contratacion ", "presentacion": "presentacion de la oferta "}

#: Fields of a notice that its coverage counts, that are only shown as evidence, and that only tender documents have.
NOTICE = (
    "objeto", "cpv", "valor_estimado", "presupuesto_base", "duracion", "lotes", "plazos", "criterios_adjudicacion", "criterios_precio", "criterios_tecnicos", "contract_meta", "opportunity_flags",
)
EVIDENCE_ONLY = ("solvencia_economica", "solvencia_tecnica")
DEFERRED = ("formulas", "documentacion_exigida", "garantia", "riesgos")
