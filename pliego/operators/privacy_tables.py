"""Fixed values of the privacy rules: rule classes, patterns and the words of keys, in their natural order."""

from __future__ import annotations

HARD = ("CREDENTIAL_KEY", "CREDENTIAL_VALUE", "PRIVATE_KEY_BLOCK", "EMAIL_VALUE", "EMAIL_KEY", "CONTACT_KEY", "CONTACT_VALUE", "PERSONAL_ID_KEY", "PERSONAL_ID_VALUE", "POPULATED_WINNING_PARTY_NIF")
PUBLIC = ("WINDOWS_ABS_PATH", "UNC_PATH", "UNIX_HOME_PATH", "RAW_PAYLOAD_CARRIER", "DANGEROUS_URL_SCHEME", "UNSAFE_URL_HOST")
HYGIENE = ("RELATIVE_TMP_PATH", "LOCAL_MARKER", "BOOKKEEPING_FIELD", "FAMILY_SOURCE_FILE", "SCHEMA_UNKNOWN")

PATTERNS = {
    "EMAIL_VALUE": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "PRIVATE_KEY_BLOCK": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    "CREDENTIAL_VALUE": (
        r"\bBearer\s+[A-Za-z0-9._\-]{10,}|\bAKIA[0-9A-Z]{16}\b|\bghp_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b|\bxox[baprs]-[A-Za-z0-9\-]{10,}"
        r"|(?i:\b(?:api[_\-]?key|secret|secret[_\-]?key|password|passwd|access[_\-]?token|auth[_\-]?token|client[_\-]?secret)\b\s*[:=]\s*\S{6,})|(?i:\bauthorization\s*:\s*\S{6,})"
    ),
    "CONTACT_VALUE": r"(?:^|[^\w+])\+\d[\d ().\-]{7,17}\d(?:[^\w]|$)",
    "WINDOWS_ABS_PATH": r"(?:^|[^A-Za-z0-9])[A-Za-z]:[\\/]",
    "UNC_PATH": r"\\\\[^\\]",
    "UNIX_HOME_PATH": r"(?:^|[\s\"'(=,:])/(?:home|Users|root)/[^/\s]",
}

CREDENTIAL_WORDS = (
    "token", "secret", "password", "passwd", "pwd", "passphrase", "contrasena", "contrasenya", "credential", "credentials", "authorization", "bearer",
    "apikey", "apitoken", "authtoken", "accesstoken", "refreshtoken", "sessiontoken", "accesskey", "secretkey", "clientsecret", "privatekey",
)
CREDENTIAL_PHRASES = (
    ("api", "key"), ("api", "token"), ("private", "key"), ("access", "token"), ("access", "key"), ("secret", "key"), ("client", "secret"),
    ("session", "token"), ("auth", "token"), ("refresh", "token"), ("bearer", "token"),
)
EMAIL_WORDS = ("email", "mail", "correo", "emailaddress", "mailaddress")
EMAIL_PHRASES = (("e", "mail"), ("email", "address"), ("mail", "address"), ("correo", "electronico"))
CONTACT_WORDS = ("phone", "tel", "telefon", "telefono", "mobile", "movil", "fax", "whatsapp")
PERSONAL_ID_WORDS = ("dni", "nie")
PHONE_LABELS = ("tel", "telefon", "telefono", "phone", "mobile", "movil", "whatsapp", "contacte", "contact", "llama", "call")
RAW_KEYS = (
    "raw", "payload", "body", "snippet", "content", "response", "traceback", "exception", "stderr", "stdout", "rawbody", "rawresponse", "rawcontent", "httpbody",
    "responsebody", "responsecontent", "sourceerrors", "helperlog",
)
RAW_PHRASES = (("raw", "body"), ("raw", "response"), ("raw", "content"), ("http", "body"), ("response", "body"), ("response", "content"), ("source", "errors"), ("helper", "log"))
BOOKKEEPING_KEYS = (
    "statusprovenance", "winnerprovenance", "sourcemergeclass", "lifecyclecategory", "lifecyclereviewrequired", "activeopportunityeligible", "productiononlypreserved",
    "enrichmentpreserved", "enrichmentversion", "enrichmentrules", "importbatch", "sourceref", "prompt", "note", "mode", "backuppath", "candidate109input", "policy110input",
    "policy111input", "generatedbyprompt", "canonicalsourcepreserved",
)
BOOKKEEPING_PREFIXES = ("dryrun", "scheduledmerge", "productionwrite", "policy", "candidate")
OPAQUE_SCHEMES = (
    "file", "ftp", "ftps", "mailto", "javascript", "vbscript", "tel", "sms", "ssh", "ldap", "gopher", "about", "blob", "filesystem", "view-source", "ws", "wss", "dict",
    "smb", "nfs", "chrome", "resource",
)

_KNOWN = """
    meta data
    id titol organisme adjudicatari tipus pressupost disciplines ccaa lloc data_pub data_limit estat estat_raw rellevancia url font kw cpv historial
    contract_folder_id canonical_key notice_type notice_type_code status_rank first_pub_date last_notice_date status_provenance winner_provenance
    related_contract_ids sources_seen award_results documents notice_history duplicate_relations source_merge_class lifecycle_category
    active_opportunity_eligible lifecycle_review_required production_only_preserved enrichment_preserved enrichment_version enrichment_rules dry_run_mode dry_run_note
    data estat nota
    notice_id result_code winning_party_name winning_party_nif award_amount_tax_excl award_amount_tax_incl lot_id lot_title contract_id award_date
    formalization_date modification_date provenance
    document_type source_section title mime_hint format_hint published_at
    status_key status_code_raw issue_date source
    tender_id relation_type
    prompt version mode production_write generated_at production_input candidate_109_input policy_110_input policy_111_input note production_write_gate_prompt
    production_write_gate_version production_write_gate_applied_at production_write_gate_backup production_write_gate_note scheduled_merge_mode
    scheduled_merge_prompt scheduled_merge_version scheduled_merge_applied_at production_write_performed backup_path run_status is_partial failed_sources
    source_errors schema generated_by_prompt target_version source source_sha256 generated_at_utc canonical_source_preserved top_shape source_meta shards
    counts year path count bytes priority source_records sharded_records duplicate_ids missing_year_records shard_meta
    name type source_ref role studio_or_context category_judged category_id is_chair import_batch source_file edition_label edition_number
    edition_number_estimated edition_number_source participants nationalities awards_count attendees_nit_laus status_note label
    updated calculadora proyectos disc horasBase experiencia tarifaHora complejidad mult urgencia recursos plantillas
"""
#: Keys of the published schema, lower case without other signs.
KNOWN_KEYS = tuple(dict.fromkeys(k.replace("_", "").lower() for k in _KNOWN.split()))
