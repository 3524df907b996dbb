"""Fixed values.

Word lists, field names, patterns and limits that have to be exactly these for results to be
right. They are data, kept together in reading order; all logic lives elsewhere.
"""

# --- field names of a collected record ------------------------------------------------------

SEQ = "序号"
SOURCE_SEQ = "原始序号"
TITLE = "标题"
ENTITY = "当事人名称"
VIOLATION = "主要违法违规行为"
BASIS = "行政处罚依据"
CONTENT = "行政处罚内容"
DOC_NO = "行政处罚决定书文号"
AUTHORITY = "作出决定机关"
DECISION_DATE = "作出决定日期"
PUBLISH_TIME = "发布时间"
CATEGORY = "类别"
CRAWL_TIME = "抓取时间"
DETAIL_URL = "详情链接"
ROW_IN_NOTICE = "批文内序号"
IS_MULTI = "是否多记录批文"
RECORD_TOTAL = "记录总数"
YES = "是"
NO = "否"

# The published ledger, in column order: collected name -> column name.
LEDGER_FIELDS = {
    SEQ: "seq_no",
    TITLE: "title",
    ENTITY: "entity_name",
    VIOLATION: "violation_behavior",
    BASIS: "punishment_basis",
    CONTENT: "punishment_content",
    DOC_NO: "decision_document_number",
    AUTHORITY: "decision_authority",
    PUBLISH_TIME: "publish_time",
    CATEGORY: "category",
    CRAWL_TIME: "crawl_time",
    DETAIL_URL: "detail_url",
}

# The older eleven-column layout.
STANDARD_FIELDS = (
    SEQ, ENTITY, VIOLATION, BASIS, CONTENT, AUTHORITY, TITLE, CATEGORY, "页码", CRAWL_TIME, DETAIL_URL,
)

# Accepted spellings -> field name.
FIELD_ALIASES = {
    "序号": SEQ,
    "当事人名称": ENTITY,
    "当事人": ENTITY,
    "主要违法违规行为": VIOLATION,
    "违法违规行为": VIOLATION,
    "违法违规": VIOLATION,
    "行政处罚内容": CONTENT,
    "处罚内容": CONTENT,
    "行政处罚": CONTENT,
    "行政处罚依据": BASIS,
    "处罚依据": BASIS,
    "依据": BASIS,
    "法律依据": BASIS,
    "作出决定机关": AUTHORITY,
    "决定机关": AUTHORITY,
    "机关": AUTHORITY,
    "抓取时间": CRAWL_TIME,
    "详情链接": DETAIL_URL,
    "标题": TITLE,
    "title": TITLE,
    "category": CATEGORY,
    "page": "页码",
}

AMOUNT_FIELDS = ("处罚金额", "罚款金额", "金额")

# --- categories -----------------------------------------------------------------------------

CATEGORIES = ("总局机关", "监管局本级", "监管分局本级")

CATEGORY_ALIASES = {
    "总局": "总局机关",
    "机关": "总局机关",
    "zhongju": "总局机关",
    "jiguan": "总局机关",
    "headquarters": "总局机关",
    "1": "总局机关",
    "监管局": "监管局本级",
    "局": "监管局本级",
    "jianguanju": "监管局本级",
    "bureau": "监管局本级",
    "local_bureau": "监管局本级",
    "2": "监管局本级",
    "监管分局": "监管分局本级",
    "分局": "监管分局本级",
    "fenju": "监管分局本级",
    "subbranch": "监管分局本级",
    "branch": "监管分局本级",
    "3": "监管分局本级",
}

# Caps that a live run of each mode has: pages and records per category; None is unlimited. Stored pages are read without.
RUN_CAPS = {
    "test": (1, 5),
    "init": (50, None),
    "monthly": (15, None),
    "daily": (3, None),
    "full": (None, None),
}
INIT_YEAR = 2025

# --- list pages -----------------------------------------------------------------------------

LINK_KEYWORDS = ("行政处罚信息公示", "行政处罚信息公开", "处罚信息")
DETAIL_HREF = "ItemDetail"
NEAR_LEVELS = 5
ISO_DAY = r"\d{4}-\d{2}-\d{2}"

# --- detail pages ---------------------------------------------------------------------------

TABLE_CLASSES = ("MsoTableGrid", "MsoNormalTable")
HORIZONTAL_HINTS = ("序号", "当事人", "违法", "处罚", "机关")
LOOSE_DAY = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"
TIME_LABEL = "时间"
SOURCE_TIME_LABELS = ("发布时间", "时间", "日期")

# Column headers: the field named by the first row whose words occur in the header.
HEADER_WORDS = {
    SEQ: ("序号",),
    ENTITY: ("当事人",),
    VIOLATION: ("违法违规", "违法行为"),
    CONTENT: ("处罚内容", "行政处罚", "处罚决定"),
    AUTHORITY: ("决定机关", "机关名称", "作出处罚决定的机关"),
    DECISION_DATE: ("决定日期", "作出处罚决定的日期"),
    BASIS: ("处罚依据",),
    DOC_NO: ("决定书文号",),
}
# Default order tries the specific headers before the general 处罚 words.
HEADER_ORDER = (SEQ, ENTITY, BASIS, DOC_NO, AUTHORITY, DECISION_DATE, VIOLATION, CONTENT)
HEADER_ORDER_COMPAT = (SEQ, ENTITY, VIOLATION, CONTENT, AUTHORITY, DECISION_DATE, BASIS, DOC_NO)

# Row labels of two-column tables: exact spellings first ...
LABELS = {
    SEQ: ("序号",),
    ENTITY: ("当事人名称", "被处罚当事人", "当事人"),
    VIOLATION: ("主要违法违规事实", "主要违法违规行为", "违法违规事实", "违法违规行为", "违法行为"),
    BASIS: ("行政处罚依据", "处罚依据"),
    CONTENT: ("行政处罚决定", "处罚决定", "行政处罚内容", "处罚内容"),
    AUTHORITY: ("作出处罚决定的机关名称", "作出决定机关", "决定机关", "机关名称", "作出处罚决定的机关"),
    DECISION_DATE: ("作出处罚决定的日期", "作出决定日期", "决定日期", "处罚决定日期"),
    DOC_NO: ("行政处罚决定书文号", "决定书文号"),
}
# ... then (field, words of which one occurs, words none of which may occur), in this order.
LABEL_WORDS = (
    (SEQ, ("序号",), ()),
    (ENTITY, ("当事人",), ()),
    (VIOLATION, ("违法违规事实", "违法违规行为", "主要违法违规", "违法行为"), ()),
    (BASIS, ("处罚依据",), ()),
    (CONTENT, ("行政处罚决定",), ("机关", "日期")),
    (CONTENT, ("处罚内容",), ()),
    (AUTHORITY, ("作出处罚决定的机关", "决定机关", "机关名称"), ("日期",)),
    (DECISION_DATE, ("作出处罚决定的日期", "决定日期"), ()),
    (DOC_NO, ("决定书文号",), ()),
)

# Fields a further row of one notice takes from the first when its own are absent or empty.
SHARED_FIELDS = (AUTHORITY, DOC_NO, TITLE, PUBLISH_TIME)

# --- text patterns --------------------------------------------------------------------------

BASIS_PATTERNS = (
    r"依据[《]?([^》。；\n]+第[^。；\n]+条[^。；\n]*)[》]?",
    r"根据[《]?([^》。；\n]+第[^。；\n]+条[^。；\n]*)[》]?",
    r"按照[《]?([^》。；\n]+第[^。；\n]+条[^。；\n]*)[》]?",
    r"《([^》]+法[^》]*)》",
    r"《([^》]+规定[^》]*)》",
    r"《([^》]+办法[^》]*)》",
    r"《([^》]+条例[^》]*)》",
    r"依据[《]?([^》。；\n]+)[》]?[，。]",
    r"根据[《]?([^》。；\n]+)[》]?[，。]",
    r"违反[了]?[《]?([^》。；\n]+)[》]?",
)
# Words without which a pattern, in the same order, cannot match.
BASIS_ANCHORS = (
    ("依据", "第", "条"), ("根据", "第", "条"), ("按照", "第", "条"),
    ("《", "法", "》"), ("《", "规定", "》"), ("《", "办法", "》"), ("《", "条例", "》"),
    ("依据",), ("根据",), ("违反",),
)
BASIS_MIN_RAW = 3
BASIS_MIN_CLEAN = 5

PERSON_PENALTY_PATTERNS = (
    r"对([^对。；\n]+?)(警告并罚款[0-9]+万元)",
    r"对([^对。；\n]+?)(罚款[0-9]+万元[^。；\n]*)",
    r"对([^对。；\n]+?)(警告[^。；\n]*)",
)
SUMMARY_PATTERNS = (
    r"(合计罚款[0-9]+万元[^。；\n]*)",
    r"(其中[^。；\n]*[0-9]+万元[^。；\n]*)",
)
PERSON_PENALTY_ANCHORS = (("对", "警告并罚款", "万元"), ("对", "罚款", "万元"), ("对", "警告"))
SUMMARY_ANCHORS = (("合计罚款", "万元"), ("其中", "万元"))
CLAUSE_START = r"(?=对[^对]*(?:警告|罚款))"
CLAUSE_WORDS = ("对", "罚款", "万元", "警告")
PENALTY_WORDS = ("罚款", "警告")
SENTENCE_MIN = 3
SENTENCE_EDGE = "。；，"
JOINER = "；"

DECISION_MARK = "罚决字"
DECISION_MIN = 5

ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))

# --- text reports and logs ------------------------------------------------------------------

TEXT_REPORT_FIELDS = (SEQ, ENTITY, VIOLATION, BASIS, CONTENT, AUTHORITY, CATEGORY, CRAWL_TIME, DETAIL_URL)
UNSAFE_IN_NAME = r'[<>:"/\\|?*]'
LABELLED_FIELDS = (
    "行政处罚决定书文号", "被处罚当事人", "主要违法违规事实", "行政处罚依据", "行政处罚决定",
    "作出处罚决定的机关名称", "作出处罚决定的日期",
)
TABLE_KEYWORD = "人寿"
TASK_MARK = "正在处理"
DONE_MARK = "智能爬取完成"
DONE_COUNT = r"共获得.*?(\d+).*?条"

# --- statistics -----------------------------------------------------------------------------

TOTAL_LABEL = "总计"
COMPLETE_LABEL = "数据完整记录"
NEW_SUFFIX = "新增"
MISSING_NAME_ISSUE = " 条记录缺少当事人名称"
MISSING_PENALTY_ISSUE = " 条记录缺少处罚内容"
UNPARSED_SEQ = 9999
