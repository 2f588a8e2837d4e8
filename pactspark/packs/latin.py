"""A rule pack for the Latin-script documents of the driver tables.

Same schemas as the contract pack; the language of a document stands for its
business type, the first word of a line that starts with a vowel for its number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from pactspark import schemas

LANGS = ("en", "fr", "de", "es")
SECTION_PATTERNS = (r"^([AEIO][a-z]*)",)

TYPE_KEYWORDS = (
    ("liability", ("token", "secret")),
    ("intellectual_property", ("icense",)),
    ("jurisdiction", ("example.com",)),
    ("confidentiality", ("555-",)),
    ("payment", ("tionre", "ungen")),
    ("acceptance", ("ereau", "schein")),
    ("force_majeure", ("cióng", "the the")),
    ("subject_matter", (" and ", " und ", " la ", " de ")),
)

# (key, value type, text before, value, text after)
METADATA = (
    ("contract_no", "string", r"", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r""),
    ("party_a_name", "string", r"[0-9]+@", r"[a-z0-9]+\.example\.com", r""),
    ("party_b_name", "string", r"icensed under the ", r"[A-Z][A-Za-z]+ [A-Z][A-Za-z]+", r""),
    ("amount", "decimal", r"", r"[0-9]{16}", r""),
)
PHONES = r"\+1 \([0-9]{3}\) 555-[0-9]{4}"
PHONE_KEYS = ("party_a_credit_code", "party_b_credit_code")

LISTED = (("mail1.example.com", "X1", "revoked", ""), ("mail5.example.com", "X5", "abnormal", ""),
          ("Apache License", "X9", "abnormal", ""))

_MENTION = {"en": " the ", "fr": " de ", "de": " der ", "es": " que "}


def rule_list(lang: str) -> list[tuple]:
    """(code, name, category, level, type, config, result, suggestion, conditions)."""
    return [
        ("SECRET_WORD", "secret in text", "data_security", "high", "keyword",
         {"keywords": ["token =", "secret"], "match_all": False}, "found in {clause_no}", "remove it", []),
        ("LICENSE_FULL", "license with version", "intellectual_property", "low", "keyword",
         {"keywords": ["icense"], "match_all": True}, "license text", None,
         [(0, "clause.content", "contains", "ersion", "string")]),
        ("CONTACT_DATA", "contact data", "confidentiality", "medium", "regex",
         {"patterns": [r"\+1 \([0-9]{3}\) 555-[0-9]{4}", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"]}, None, "mask it", []),
        ("CARD_NUMBER", "card number", "confidentiality", "high", "regex", {"patterns": ["unused"]}, None, None,
         [(0, "clause.content", "regex", "[0-9]{16}", "regex")]),
        ("MAIL_TERMS", "listed mail host", "jurisdiction", "medium", "blacklist",
         {"blacklist": ["@mail1.", "@mail5.", "@mail3."]}, None, None, []),
        ("RATIO_OVER", "ratio over limit", "liability", "medium", "threshold",
         {"metric": "penalty_ratio", "threshold": 20, "direction": "gt"}, "over {threshold}", None, []),
        ("UNEVEN", "uneven wording", "liability", "high", "threshold",
         {"metric": "liability_asymmetry", "severe_keywords": ["token =", "555-"],
          "mild_keywords": ["icense", "@mail"], "mild_ratio_max": 5}, None, None, []),
        ("TYPES_MISSING", "section types missing", "amount_payment", "medium", "presence",
         {"required_clause_type": ["payment", "acceptance"]}, None, None, []),
        ("KEYS_MISSING", "keys missing", "subject_qualification", "low", "presence",
         {"required_keys": ["contract_no"]}, None, None,
         [(0, "metadata.amount", "not_exists", None, "string")]),
        ("WORD_MISSING", "usual word missing", "other", "low", "presence",
         {"required_pattern": _MENTION[lang]}, None, None, []),
        ("WITHIN_MISSING", "word missing in section", "acceptance", "medium", "presence",
         {"within_clause_type": "subject_matter", "required_pattern": "tion", "anchor_keywords": ["en"]}, None, None, []),
        ("AMOUNT_OVER", "large amount", "amount_payment", "medium", "threshold",
         {"metric": "amount", "threshold": 4500000000000000, "direction": "gte"}, None, None, []),
        ("SUBJECT_LISTED", "listed subject", "subject_qualification", "high", "blacklist",
         {"source": "subject_blacklist"}, None, None, []),
    ]


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, lang, f"{lang} list", "", lang != "es") for i, lang in enumerate(LANGS, start=1)]
    return spark.createDataFrame(rows, schemas.TEMPLATES)


def rules(spark: SparkSession) -> DataFrame:
    rows = []
    for t, lang in enumerate(LANGS, start=1):
        for seq, (code, name, category, level, kind, config, result, advice, conditions) in enumerate(rule_list(lang)):
            rows.append((t * 100 + seq, t, code, name, category, level, kind, json.dumps(config), result, advice,
                         code != "UNUSED", seq, conditions))
    return spark.createDataFrame(rows, schemas.RULES)


def blacklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LISTED), schemas.BLACKLIST)


# required things per language: (kind, key, level, title, reason, category)
REQUIRED = {
    lang: [("clause", "subject_matter", "high", "no subject", "subject section missing", "other"),
           ("metadata", "party_a_name", "medium", "no party", "party missing", "subject_qualification")]
    for lang in ("en", "fr", "de")
}

# keywords -> verdict
REPLAY = (
    (("token =",), ("token in the open", "high", "data_security", "a token is readable", "", "remove", "token =")),
    (("555-",), ("phone number", "medium", "confidentiality", "a phone number is readable", "Privacy Act", "mask", "555-")),
    (("icense",), ("license text", "low", "intellectual_property", "license found", "Apache License", "check", "icense")),
)
