"""Fixed values of the notice domain: codes, ranks, word lists and ranges.

These must agree with published data and are stated as they are, in their natural order.
"""

from __future__ import annotations

#: Status of a notice by its code.
STATUS_BY_CODE = {
    "PUB": "Vigente", "PRE": "Vigente", "EV": "Vigente",
    "ADJ": "Adjudicado", "RES": "Adjudicado", "FOR": "Adjudicado",
    "ANU": "Desierta", "DES": "Desierta", "SUS": "Desierta", "ANUL": "Desierta",
}

#: Notice type by status code; other codes have none.
NOTICE_TYPE_BY_CODE = {"PUB": "PUB", "EV": "EV", "PRE": "PRE", "ADJ": "AWARD", "RES": "RES", "FOR": "FORMALIZATION", "DEL": "CANCELLED"}

#: How far a procurement has come by notice type.
RANK_BY_NOTICE_TYPE = {
    "FORMALIZATION": 10, "CONTRACT_MODIFICATION": 9, "AWARD": 8, "ADJ": 8, "RES": 7, "EV": 4,
    "PRE": 3, "PUB": 2, "PRIOR": 1, "CANCELLED": 0, "UNKNOWN": 0,
}

CONTRACT_TYPES = {"1": "Suministros", "2": "Servicios", "3": "Obras"}

TERRITORIES = {
    "AN": "Andalucía", "AR": "Aragón", "AS": "Asturias", "IB": "Baleares", "CN": "Canarias",
    "CB": "Cantabria", "CM": "Castilla-La Mancha", "CL": "Castilla y León", "CT": "Catalunya",
    "EX": "Extremadura", "GA": "Galicia", "RI": "La Rioja", "MD": "Madrid", "MU": "Murcia",
    "NA": "Navarra", "PV": "País Vasco", "VC": "C. Valenciana", "ES": "Estatal",
}

#: Words of a status text, as parts of words.
OPEN_WORDS = ("vigent", "en plazo", "activ", "publicad", "anunciad", "open", "actiu")
CLOSED_WORDS = ("adjudicad", "award", "desiert", "deserta", "closed", "cancelad", "resolt", "resolut", "terminad", "finalizad", "archivad")

#: Words that say a notice was void.
VOID_WORDS = ("desierta", "deserta", "sin adjudicar", "sense adjudicació", "declarada desierta", "sin licitadores")

#: Fields that a merge never takes from a candidate.
KEPT_FROM_PRODUCTION = ("enrichment_version", "enrichment_rules", "rellevancia", "kw", "cpv", "ccaa", "lloc", "tipus")
PROVENANCE_PREFIXES = ("recovery_", "delta_", "merge_")
UNITED_LISTS = ("historial", "notice_history", "award_results", "documents", "related_contract_ids", "sources_seen", "duplicate_relations")

#: Fields whose disagreement a merge reports.
CONFLICT_FIELDS = ("estat", "status", "adjudicatari", "adjudicatario", "pressupost", "budget", "data_pub", "data_limit", "organisme", "titol", "title", "titulo", "url")

BUDGET_BUCKETS = ("< 10K", "10K–50K", "50K–100K", "100K–500K", "> 500K", "Sin presupuesto")

#: Phrases of a title that shut a notice out.
TITLE_OUT = [
    "obra civil", "obras de", "reforma de", "instalación de", "instalaciones de",
    "suministro de energía", "suministro e instalación", "suministro y montaje",
    "suministro de módulos", "módulos sanitarios", "módulos prefabricados",
    "suministro de agua", "suministro de gas", "suministro de combustible",
    "mantenimiento de edificio", "mantenimiento del edificio", "mantenimiento y reparación",
    "mantenimiento preventivo", "mantenimiento correctivo", "limpieza de", "servicio de limpieza",
    "servicios de limpieza", "seguridad privada", "vigilancia", "control de accesos",
    "recogida de residuos", "gestión de residuos", "tratamiento de residuos", "basuras",
    "reciclaje", "compostaje", "planta de tratamiento", "transporte de viajeros",
    "transporte escolar", "servicio de transporte", "contratación de vuelos",
    "arrendamiento de vehículos", "asistencia sanitaria", "atención sanitaria",
    "servicio médico", "material sanitario", "material clínico", "equipamiento médico",
    "bombas de agua", "grupo de bombeo", "sistema de bombeo", "catering",
    "servicio de comedor", "servicio de cafetería", "suministro de alimentos",
    "seguridad informática", "ciberseguridad", "consultoría jurídica", "asesoría fiscal",
    "auditoría de cuentas", "préstamo", "arrendamiento financiero", "póliza de seguros",
    "seguro de", "suministro de uniformes", "mantenimiento de parques",
    "mantenimiento de jardines", "mantenimiento de carreteras", "señalización vial",
    "señalización horizontal", "señalización vertical", "pintura de", "pintura vial",
    "alquiler de", "arrendamiento de", "suministro de mobiliario",
    "suministro de material de oficina", "suministro de equipamiento",
    "adquisición de equipamiento", "adquisición de vehículos", "adquisición de maquinaria",
]

#: Phrases of a title of which one must occur.
TITLE_IN = [
    "diseño gráfico", "disseny gràfic", "diseño y maquetación",
    "identidad corporativa", "identitat corporativa", "imagen corporativa", "imatge corporativa",
    "manual de identidad", "manual de marca", "manual corporativo", "comunicación visual",
    "comunicació visual", "comunicación gráfica", "diseño editorial", "disseny editorial",
    "maquetación", "maquetació", "autoedición", "infografía", "infografia", "cartelería",
    "cartelleria", "diseño de cartel", "diseño de carteles", "ilustración", "il·lustració",
    "tipografía", "logotipo", "logotip", "logomarca", "branding", "campaña publicitaria",
    "campanya publicitària", "campaña de comunicación", "campaña de publicidad",
    "spot publicitario", "material promocional", "material divulgativo", "material divulgatiu",
    "material de comunicación", "material comunicatiu", "folletos", "fullets", "dípticos",
    "trípticos", "producción gráfica", "artes gráficas", "arts gràfiques", "rotulación",
    "retolació", "diseño web", "disseny web", "diseño de página web", "diseño de portal",
    "diseño ux", "diseño ui", "ux/ui", "experiencia de usuario", "señalética", "senyalètica",
    "señalización corporativa", "sistema de señalización", "museografía", "museografia",
    "diseño de exposición", "diseño museográfico", "producción audiovisual",
    "producció audiovisual", "motion graphics", "animación gráfica", "vídeo corporativo",
    "video corporativo", "fotografía corporativa", "fotografía de producto",
    "reportaje fotográfico", "artes finales", "impresión de", "servicios de impresión",
    "servicios de comunicación", "serveis de comunicació", "servicios de diseño",
    "serveis de disseny", "relaciones públicas", "relacions públiques",
    "estrategia de comunicación", "pla de comunicació", "plan de comunicación",
]

STRONG_WORDS = [
    "diseño gráfico", "disseny gràfic", "identidad corporativa", "imagen corporativa",
    "manual de marca", "comunicación visual", "maquetación", "infografía", "cartelería",
    "producción gráfica", "artes gráficas", "branding", "campaña publicitaria",
    "material promocional", "señalética", "museografía", "producción audiovisual",
    "motion graphics",
]

MEDIUM_WORDS = [
    "diseño", "disseny", "comunicación", "comunicació", "publicidad", "publicitat",
    "marca", "marketing", "edición", "editorial", "fotografía", "fotografia",
    "ilustración", "impresión", "audiovisual", "animación", "exposición",
]

#: Keywords of each discipline.
DISCIPLINE_WORDS = {
    "branding": ["branding", "identidad corporativa", "identitat corporativa", "logotipo", "logotip", "logo", "manual de marca",
                 "manual de identidad", "imagen corporativa", "identidad visual", "identitat visual"],
    "editorial": ["editorial", "maquetación", "maquetació", "revista", "catálogo", "catàleg", "folleto", "fullet", "cartel", "cartell",
                  "infografía", "memoria anual", "publicación", "publicació", "díptico", "tríptico", "diseño gráfico", "disseny gràfic",
                  "comunicación visual", "comunicació visual", "producción gráfica", "producció gràfica", "artes finales"],
    "web": ["diseño web", "disseny web", "página web", "pàgina web", "sitio web", "portal web", "wordpress", "diseño digital"],
    "uxui": ["ux", "ui", "experiencia de usuario", "usabilidad", "interfaz", "app", "aplicación", "ux/ui", "experiència d'usuari"],
    "publicitat": ["publicidad", "publicitat", "campaña publicitaria", "campanya publicitària", "marketing", "màrqueting", "promoción",
                   "spot publicitario", "material promocional", "materiales promocionales"],
    "senyaletica": ["señalética", "senyalètica", "rotulación", "retolació", "señalización corporativa", "museografía",
                    "diseño de exposición", "expositores", "señales"],
    "fotografia": ["fotografía corporativa", "fotografía de producto", "reportaje fotográfico", "fotografía profesional"],
    "audiovisual": ["producción audiovisual", "producció audiovisual", "vídeo corporativo", "motion graphics", "animación gráfica", "spot",
                    "multimedia"],
    "illustracio": ["ilustración", "il·lustració", "ilustración editorial"],
    "impressio": ["impresión", "impressió", "artes gráficas", "arts gràfiques", "offset", "serigrafía", "impresión gran formato",
                  "impressió gran format"],
}

#: Keywords of each territory, in the order in which they are tried.
TERRITORY_WORDS = {
    "CT": ["cataluña", "catalunya", "barcelona", "girona", "lleida", "tarragona", "generalitat de catalunya", "diputació de barcelona",
           "ajuntament de barcelona", "ajuntament de girona", "ajuntament de lleida", "ajuntament de tarragona"],
    "MD": ["madrid", "comunidad de madrid", "ayuntamiento de madrid"],
    "AN": ["andalucía", "andalucia", "sevilla", "málaga", "granada", "córdoba", "junta de andalucía"],
    "PV": ["país vasco", "pais vasco", "euskadi", "bilbao", "donostia", "vitoria", "gobierno vasco", "diputación foral"],
    "VC": ["comunitat valenciana", "comunidad valenciana", "valencia", "valència", "alicante", "alacant", "castellón", "castelló",
           "generalitat valenciana"],
    "GA": ["galicia", "xunta de galicia", "vigo", "a coruña", "santiago", "pontevedra"],
    "AR": ["aragón", "aragon", "zaragoza", "gobierno de aragón"],
    "CM": ["castilla-la mancha", "toledo", "albacete", "ciudad real"],
    "CL": ["castilla y león", "valladolid", "burgos", "salamanca", "junta de castilla y león"],
    "MU": ["región de murcia", "murcia"],
    "NA": ["navarra", "pamplona", "gobierno de navarra"],
    "IB": ["baleares", "illes balears", "mallorca", "ibiza", "calvià", "calvia", "palma"],
    "CN": ["canarias", "tenerife", "las palmas", "gobierno de canarias"],
    "EX": ["extremadura", "badajoz", "cáceres"],
    "AS": ["asturias", "oviedo", "principado de asturias"],
    "CB": ["cantabria", "santander"],
    "RI": ["la rioja", "gobierno de la rioja"],
    "ES": ["ministerio", "gobierno de españa", "administración general del estado", "agencia estatal", "organismo autónomo"],
}

#: Patterns of a text that name the contracting body, in the order in which they are tried; the group is the name, or the whole match.
ORGANISATION_PATTERNS = (
    r"(?:órgano de contratación|organo de contratacion)\s*[:\-]\s*([^|\n.;]{4,140})",
    r"(?:entidad adjudicadora|poder adjudicador)\s*[:\-]\s*([^|\n.;]{4,140})",
    r"(?:autoridad portuaria de [^|\n.;]{2,80})",
    r"(?:ayuntamiento de [^|\n.;]{2,80})",
    r"(?:ajuntament de [^|\n.;]{2,80})",
    r"(?:diputaci[oó]n de [^|\n.;]{2,80})",
    r"(?:diputaci[oó] de [^|\n.;]{2,80})",
    r"(?:cabildo (?:insular )?de [^|\n.;]{2,80})",
    r"(?:universidad de [^|\n.;]{2,80})",
    r"(?:universitat de [^|\n.;]{2,80})",
    r"(?:ministerio de [^|\n.;]{2,80})",
    r"(?:conseller[ií]a de [^|\n.;]{2,80})",
    r"(?:consejería de [^|\n.;]{2,80})",
    r"(?:mancomunidad de [^|\n.;]{2,80})",
    r"(?:consorcio de [^|\n.;]{2,80})",
    r"(?:patronato de [^|\n.;]{2,80})",
)

#: Patterns of an amount, in the order in which they are tried.
AMOUNT_PATTERNS = (
    r"presupuesto base de licitaci[oó]n[^:]*:\s*([\d\.,]+)",
    r"valor estimado del contrato[^:]*:\s*([\d\.,]+)",
    r"importe de licitaci[oó]n[^:]*:\s*([\d\.,]+)",
    r"importe total[^:]*:\s*([\d\.,]+)",
    r"presupuesto[^:]*:\s*([\d\.,]+)\s*(?:€|euros|eur)",
    r"[Ii]mporte\s*:?\s*([\d\.,]+)\s*(?:EUR|€|euros|eur)\b",
    r"[Ii]mporte\s*:?\s*([\d\.,]+)EUR",
    r"([\d\.,]+)\s*(?:€|euros)\b",
)

#: Patterns of a deadline, in the order in which they are tried.
DEADLINE_PATTERNS = (
    r"fecha l[íi]mite de presentaci[oó]n[^:]*:\s*(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})",
    r"plazo de presentaci[oó]n[^:]*:\s*(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})",
    r"presentaci[oó]n de ofertas[^:]*:\s*(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})",
    r"termini[^:]*:\s*(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})",
)

#: A text that says that a contract was awarded.
AWARDED_PATTERN = r"\b(?:adjudica(?:do|da|t)|resuelt[ao]|formalizado)\b"


#: Texts of a notice in one sentence, by language, and short names of months.
SUMMARY = {
    "es": {
        "full": "Licitación de {disc} para {org}, con presupuesto {budget} y {deadline}.", "plain": "Licitación para {org}, con presupuesto {budget} y {deadline}.", "no_budget": "no disponible", "deadline": "plazo hasta {date}",
        "no_deadline": "sin plazo publicado", "expires": "Vence en {n} días", "awarded": "Adjudicada", "void": "Declarada desierta", "months": ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic"],
    },
    "ca": {
        "full": "Licitació de {disc} per a {org}, amb pressupost {budget} i {deadline}.", "plain": "Licitació per a {org}, amb pressupost {budget} i {deadline}.", "no_budget": "no disponible", "deadline": "termini fins {date}",
        "no_deadline": "sense termini publicat", "expires": "Venç en {n} dies", "awarded": "Adjudicada", "void": "Declarada deserta", "months": ["gen", "febr", "març", "abr", "maig", "juny", "jul", "ag", "set", "oct", "nov", "des"],
    },
}

#: Notices that stand in for a data set that cannot be read: id, title, body, awardee, budget, disciplines, territory, published, deadline, status, relevance.
SAMPLE = (
    ("s1", "Diseño de identidad corporativa y manual de marca — Ajuntament de Girona", "Ajuntament de Girona", "", 28500.0, ["branding", "editorial"], "CT", None, "2026-04-20", "Vigente", 95),
    ("s2", "Servicio de diseño gráfico y producción de materiales — SEPE", "Servicio Público de Empleo Estatal", "", 120000.0, ["editorial", "impressio"], "MD", "2026-03-08", "2026-04-15", "Vigente", 92),
    ("s3", "Diseño museográfico y señalética — MNAC", "Museu Nacional d'Art de Catalunya", "Studio Baldrich S.L.", 320000.0, ["senyaletica", "branding"], "CT", "2026-02-18", "2026-03-01", "Adjudicado", 90),
    ("s4", "Campaña publicitaria de promoción turística — Agència Catalana de Turisme", "Agència Catalana de Turisme", "", 450000.0, ["publicitat", "branding"], "CT", "2026-03-07", "2026-04-10", "Vigente", 88),
    ("s5", "Producción audiovisual y motion graphics — RTVE", "RTVE", "", 85000.0, ["audiovisual"], "MD", "2026-03-01", "2026-04-05", "Vigente", 83),
    ("s6", "Serveis de fotografia institucional — Diputació de Barcelona", "Diputació de Barcelona", "", 22000.0, ["fotografia"], "CT", "2026-02-28", "2026-04-01", "Vigente", 80),
    ("s7", "Diseño web y sistema de comunicación digital — Gobierno de Navarra", "Gobierno de Navarra", "", 195000.0, ["web", "uxui"], "NA", "2026-02-25", "2026-04-25", "Vigente", 78),
    ("s8", "Ilustración editorial para campaña — Junta de Andalucía", "Junta de Andalucía", "", 18000.0, ["illustracio", "editorial"], "AN", "2026-03-10", "2026-03-28", "Vigente", 75),
    ("s9", "Impresión y producción gráfica de materiales institucionales — Ministerio de Cultura", "Ministerio de Cultura", "Gràfiques Valls S.A.", 67000.0, ["impressio", "editorial"], "MD", "2026-01-15", "2026-02-01", "Adjudicado", 72),
    ("s10", "Señalética y rotulación — Ayuntamiento de Vitoria-Gasteiz", "Ayuntamiento de Vitoria-Gasteiz", "", 35000.0, ["senyaletica"], "PV", "2026-03-05", "2026-04-30", "Desierta", 70),
)
