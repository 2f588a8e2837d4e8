"""Word lists, lookup tables, patterns, thresholds and formats.

Everything in this module is data that results depend on. It is stated as plain
text in its natural order; no logic lives here.
"""

from __future__ import annotations

# ---- enumerations (fixed values) -------------------------------------------

ENUMS: dict[str, tuple[str, ...]] = {
    "task_status": ("pending", "parsing", "reviewing", "blocked", "completed"),
    "writeback_status": ("not_written", "writing", "success", "failed"),
    "blocked_reason": ("encrypted", "empty_content", "blurred", "timeout",
                       "converter_unavailable", "error"),
    "task_event_type": ("status_change", "retry", "blocked", "progress"),
    "risk_level": ("high", "medium", "low"),
    "risk_category": ("subject_qualification", "amount_payment", "liability",
                      "intellectual_property", "jurisdiction", "confidentiality",
                      "data_security", "acceptance", "force_majeure", "other"),
    "merged_by": ("rule", "llm", "both", "manual"),
    "review_conclusion": ("pass", "rectify", "reject"),
    "evidence_type": ("rule", "llm", "law", "manual"),
    "clause_type": ("subject_matter", "payment", "acceptance", "liability",
                    "confidentiality", "data_security", "jurisdiction",
                    "intellectual_property", "force_majeure", "other"),
    "parse_method": ("docx_wps_com", "docx_libreoffice", "docx_passthrough",
                     "pdf_native", "ocr_rapidocr"),
    "parse_status": ("success", "partial", "failed"),
    "anchor_source": ("native_text", "ocr"),
    "anchor_level": ("exact", "fuzzy", "paragraph", "none"),
    "file_format": ("docx", "pdf", "scanned_pdf", "image"),
    "contract_source": ("upload", "approval_sync"),
    "business_type": ("purchase", "sales", "service", "labor"),
    "rule_type": ("keyword", "regex", "threshold", "presence", "blacklist"),
    "rule_operator": ("contains", "not_contains", "regex", "gt", "gte", "lt", "lte",
                      "eq", "exists", "not_exists"),
    "value_type": ("string", "decimal", "date", "regex", "list"),
    "metadata_key": ("party_a_name", "party_b_name", "party_a_credit_code",
                     "party_b_credit_code", "contract_no", "amount", "currency",
                     "term", "effective_condition", "sign_date", "sign_place"),
}

LEVEL_WEIGHT = {"low": 1, "medium": 2, "high": 3}

CONCLUSION_OF_LEVEL = {"high": "reject", "medium": "rectify", "low": "pass"}

# ---- labels (fixed values) ----------------------------------------------------

LABELS: dict[str, dict[str, str]] = {
    "risk_level": {"high": "高风险", "medium": "中风险", "low": "低风险"},
    "risk_level_icon": {"high": "🔴", "medium": "🟠", "low": "🟡"},
    "review_conclusion": {"pass": "通过", "rectify": "建议整改", "reject": "建议拒绝"},
    "merged_by": {"rule": "规则命中", "llm": "AI 研判", "both": "规则 + AI 双重确认",
                  "manual": "人工添加"},
    "anchor_level": {"exact": "精确", "fuzzy": "模糊", "paragraph": "段落级"},
    "metadata_key": {
        "contract_no": "合同编号", "party_a_name": "甲方", "party_b_name": "乙方",
        "party_a_credit_code": "甲方统一社会信用代码",
        "party_b_credit_code": "乙方统一社会信用代码",
        "amount": "合同金额", "currency": "币种", "term": "履约期限",
        "effective_condition": "生效条件", "sign_date": "签订日期", "sign_place": "签订地点",
    },
    "missing_metadata": {"party_a_name": "甲方名称", "party_b_name": "乙方名称",
                         "amount": "合同金额", "currency": "币种"},
}

# ---- text (fixed values) ------------------------------------------------------

PUNCTUATION_PAIRS = {
    "，": ",", "。": ".", "、": ",", "；": ";", "：": ":", "？": "?", "！": "!",
    "（": "(", "）": ")", "【": "[", "】": "]", "《": "<", "》": ">",
    "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "－": "-", "～": "~",
    "·": ".", "　": " ",
}

ELLIPSIS_PATTERN = r"\.{2,}|。{2,}|·{3,}|…+"

FRAGMENT_SEPARATORS = "，。；：、！？,.;:!?\n\r\t 　（）()【】[]《》<>“”\"'"
FRAGMENT_MIN_LENGTH = 4

SENTENCE_MARKS = "。；;."
TITLE_MAX_CHARS = 40
TITLE_STRIP = " \t、.．:："

# ---- sections (fixed values) --------------------------------------------------

CLAUSE_NO_PATTERNS = (
    r"^\s*(第[一二三四五六七八九十百零〇\d]+[条章节款项])",
    r"^\s*(\d+(?:\.\d+){0,3})[\s、.．]",
    r"^\s*([一二三四五六七八九十]+)[、.．]",
)

CLAUSE_TYPE_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("liability", ("违约责任", "赔偿责任", "违约金", "损失赔偿")),
    ("intellectual_property", ("知识产权", "著作权", "专利", "商标", "成果归属")),
    ("jurisdiction", ("争议解决", "管辖", "仲裁", "诉讼")),
    ("confidentiality", ("保密", "商业秘密", "保密义务")),
    ("data_security", ("数据安全", "个人信息", "数据保护")),
    ("acceptance", ("验收", "检验", "质检")),
    ("payment", ("付款", "支付", "价款", "结算", "费用", "合同金额", "总金额",
                 "合同价格", "合同价款")),
    ("force_majeure", ("不可抗力",)),
    ("subject_matter", ("标的", "货物", "产品", "服务内容", "设备")),
)

# ---- metadata (fixed values) --------------------------------------------------
# (key, value type, text before the value, the value, text after the value)

METADATA_PATTERNS: tuple[tuple[str, str, str, str, str], ...] = (
    ("party_a_name", "string", r"甲方[（(]?[^）)\n]*[）)]?\s*[:：]\s*", r"[^\n，,。；;]{2,60}", ""),
    ("party_b_name", "string", r"乙方[（(]?[^）)\n]*[）)]?\s*[:：]\s*", r"[^\n，,。；;]{2,60}", ""),
    ("contract_no", "string", r"合同编号\s*[:：]\s*", r"[A-Za-z0-9\-_/]{3,64}", ""),
    ("sign_date", "date", r"(?:签订|签署)日期\s*[:：]?\s*",
     r"\d{4}\s*[-年/]\s*\d{1,2}\s*[-月/]\s*\d{1,2}\s*日?", ""),
    ("sign_place", "string", r"(?:签订|签署)地点\s*[:：]\s*", r"[^\n，,。；;]{2,60}", ""),
    ("amount", "decimal",
     r"(?:合同(?:总)?(?:金额|价款|价格)|总金额|价款)(?:[（(][^）)]{0,20}[）)])?"
     r"\s*[:：为]?\s*(?:人民币|RMB|￥|¥)?\s*", r"[\d,]+(?:\.\d{1,2})?", ""),
    ("currency", "currency", "", r"人民币|美元|欧元|港币|日元|CNY|USD|EUR|HKD|JPY", ""),
    ("term", "string", r"(?:履行|合同)期限\s*[:：]?\s*", r"[^\n，,。；;]{2,60}", ""),
    ("effective_condition", "string",
     r"(?:本合同|本协议|合同|协议)[^。\n]{0,8}?(?:自|经|于)", r"[^。\n]{2,60}?",
     r"(?:之日)?(?:起|后)?生效"),
)

CREDIT_CODE_PATTERN = r"[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}"

CURRENCY_CODES = {"人民币": "CNY", "美元": "USD", "欧元": "EUR", "港币": "HKD", "日元": "JPY"}

REVIEW_CONFIDENCE = 0.85

# ---- ratios (fixed values) ----------------------------------------------------

PERCENT_PATTERN = r"(\d+(?:\.\d+)?)\s*%"
CN_PERCENT_PATTERN = r"百分之([一二三四五六七八九十百零〇\d]+)"
CN_DIGITS = "零〇一二三四五六七八九"
CN_DIGIT_VALUES = "00123456789"

# ---- rule engine (fixed values) -----------------------------------------------

CATEGORY_TO_CLAUSE_TYPE = {
    "confidentiality": "confidentiality", "force_majeure": "force_majeure",
    "acceptance": "acceptance", "intellectual_property": "intellectual_property",
    "jurisdiction": "jurisdiction", "amount_payment": "payment",
    "liability": "liability", "data_security": "data_security",
}

PROBATION_WORD = "试用期"
GLOBAL_CLAUSE_LABEL = "全局"

THRESHOLD_METRICS = ("penalty_ratio", "amount", "liability_asymmetry", "probation_pay_ratio")
METRICS_WITHOUT_THRESHOLD = ("liability_asymmetry",)
DIRECTIONS = ("gt", "gte", "lt", "lte", "eq")

READABLE_OPERATORS = {
    "keyword": ("contains",), "regex": ("regex",), "blacklist": ("contains", "regex"),
    "presence": ("not_exists",), "threshold": (),
}
UNIVERSAL_OPERATORS = ("exists",)
NEVER_READ_OPERATORS = ("not_contains", "gt", "gte", "lt", "lte", "eq")
OPERATORS_NEEDING_VALUE = ("contains", "not_contains", "regex", "gt", "gte", "lt", "lte", "eq")
OPERATORS_WITHOUT_VALUE = ("exists", "not_exists")
CLAUSE_FIELDS = ("content", "clause_type", "clause_no", "title")
RULE_CODE_PATTERN = r"[A-Z][A-Z0-9_]*"

# ---- global floor (fixed values) ----------------------------------------------

REQUIRED_CLAUSE_TYPES = {
    "purchase": ("subject_matter", "payment", "acceptance", "liability"),
    "sales": ("subject_matter", "payment", "liability"),
    "service": ("subject_matter", "payment", "liability", "confidentiality"),
    "labor": ("payment", "liability"),
}

# (key, level, reason, category)
REQUIRED_METADATA_ALL = (
    ("party_a_name", "high", "甲方名称缺失，无法核实主体资质", "subject_qualification"),
    ("party_b_name", "high", "乙方名称缺失，无法核实主体资质", "subject_qualification"),
)
REQUIRED_METADATA_TRADE = (
    ("amount", "medium", "合同金额缺失，比例类规则无法判定", "amount_payment"),
    ("currency", "medium", "币种缺失，涉外场景下金额存在歧义", "amount_payment"),
)
TRADE_TYPES = ("purchase", "sales", "service")
GLOBAL_EVIDENCE_TITLE = "必备条款全局校验"

# ---- merge and anchors (fixed values) -----------------------------------------

MERGE_SIMILARITY = 0.55
FUZZY_SIMILARITY = 0.72
FUZZY_ALIGN = 8
FUZZY_SEED = 6
FUZZY_MIN_LENGTH = 4

# ---- model verdicts (fixed values) --------------------------------------------

CLAUSES_PER_BATCH = 8
FENCE_PATTERN = r"(?s)```(?:json|JSON)?\s*(.*?)```"

# ---- parsing facts (fixed values) ---------------------------------------------

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
MIN_TEXT_CHARS = 20
MIN_PAGE_CHARS = 10
MIN_OCR_CONFIDENCE = 0.5
BASE_TIMEOUT_SECONDS = 60
PAGE_TIMEOUT_SECONDS = 30
POINTS_PER_INCH = 72
METRIC_HEIGHT_LIMIT = 1.6
METRIC_ASCENDER = 0.88
METRIC_DESCENDER = -0.12

# ---- task state (fixed values) ------------------------------------------------

TRANSITIONS = (
    ("pending", "parsing"), ("pending", "blocked"), ("parsing", "reviewing"),
    ("parsing", "blocked"), ("reviewing", "completed"), ("reviewing", "blocked"),
    ("blocked", "parsing"),
)
STALE_DETAIL = "进程重启或执行超时，任务被标记为受阻，可重试"
PROGRESS_TTL_SECONDS = 24 * 3600

# ---- blacklist (fixed values; invented companies) ------------------------------

BLACKLIST = (
    ("松岭样例商贸有限公司", "91110000MA00TEST1A", "经营异常", "样例：年报逾期未报"),
    ("白桥样例软件有限公司", "91310000MA00TEST2B", "严重违法失信", "样例：列入失信名单"),
    ("青屿样例物流有限公司", "91440000MA00TEST3C", "注销", "样例：登记已注销"),
    ("石川样例建材有限公司", "91500000MA00TEST4D", "经营异常", "样例：登记地址查无此企业"),
    ("云麓样例电器有限公司", "91510000MA00TEST5E", "严重违法失信", "样例：税务处罚未履行"),
)
