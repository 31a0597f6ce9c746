"""Word lists, maps and patterns of Vietnamese legal text that results depend on."""

# Stop words.
STOP_WORDS = [
    "và", "của", "các", "có", "được", "cho", "trong", "với", "không",
    "là", "đến", "tại", "theo", "sau", "khi", "trên", "như", "này",
    "việc", "bị", "đã", "sẽ", "đang", "để", "về", "từ", "hoặc",
    "thì", "mà", "do", "nếu", "vì", "nên", "ra", "lại", "đó",
    "những", "một", "người", "cần", "phải", "cũng", "hay", "qua",
]

# Abbreviations of legal terms.
LEGAL_TERMS = {
    "ld": "lao động",
    "lđ": "lao động",
    "blđ": "bộ luật lao động",
    "bl": "bộ luật",
    "nd": "nghị định",
    "tt": "thông tư",
    "cp": "chính phủ",
    "qđ": "quyết định",
    "ct": "chỉ thị",
    "hđ": "hợp đồng",
    "tn": "thu nhập",
    "bh": "bảo hiểm",
    "bhxh": "bảo hiểm xã hội",
    "bhyt": "bảo hiểm y tế",
    "hcsn": "hành chính sự nghiệp",
    "tncn": "thu nhập cá nhân",
    "gtgt": "giá trị gia tăng",
    "tdn": "thu nhập doanh nghiệp",
    "tnc": "thu nhập chịu thuế",
    "qt": "quyết toán",
}

# Abbreviations in names of laws.
LAW_NAME_TERMS = {
    "dnnvv": "doanh nghiệp nhỏ và vừa",
    "shtt": "sở hữu trí tuệ",
    "bllđ": "bộ luật lao động",
    "ld": "lao động",
    "bhxh": "bảo hiểm xã hội",
    "bhyt": "bảo hiểm y tế",
    "tncn": "thu nhập cá nhân",
    "gtgt": "giá trị gia tăng",
    "xd": "xây dựng",
    "bvmt": "bảo vệ môi trường",
    "ntd": "người tiêu dùng",
}

# Forms of document codes, in order of priority. W stands for a word character of any script, which Java
# and DuckDB write as a class of their own ([\p{L}\p{N}_]); see quern.functions.text.WORD.
DOC_CODES = [
    r"\d+/\d{4}/QH\d+",
    r"\d+/\d{4}/NĐ-W+",
    r"\d+/\d{4}/TT-W+",
    r"\d+/\d{4}/CTN",
    r"\d+/\d{4}/NQ-W+",
    r"\d+/\d{4}/QĐ-W+",
    r"\d+/\d{4}/CT-W+",
    r"\d+/NQ-W+",
    r"\d+/QĐ-W+",
    r"\d+/CT-W+",
    r"\d+/NĐ-W+",
    r"\d+/TT-W+",
]

# Forms of references, by type; group 1 is the value.
REFERENCES = {
    "article": r"Điều\s+(\d+)",
    "clause": r"Khoản\s+(\d+)",
    "decree": r"Nghị định\s+(\d+/\d+/W+(?:-W+)?)",
    "circular": r"Thông tư\s+(\d+/\d+/W+(?:-W+)?)",
    "law": r"Luật\s+([^,;.*\s]+(?:[ \t]+[^,;.*\s]+){0,3})",
    "code": r"Bộ luật\s+([^,;.*\s]+(?:[ \t]+[^,;.*\s]+){0,3})",
}

# Types of documents that are kept.
KEPT_TYPES = [
    "Luật", "Bộ luật", "Hiến pháp", "Pháp lệnh",
    "Nghị định", "Thông tư", "Thông tư liên tịch",
    "Văn bản hợp nhất", "Nghị quyết",
    "Chỉ thị", "Hướng dẫn", "Quyết định",
    "Quy định", "Quy chế",
    "Văn bản khác",
    "Điều ước quốc tế", "Điều ước", "Điều lệ",
]

# Kinds of laws at the start of a name, in order of trial.
LAW_KINDS = ["bộ luật", "thông tư liên tịch", "nghị định", "thông tư", "quyết định", "chỉ thị", "nghị quyết", "pháp lệnh", "luật"]

# Kinds of questions and the plan of each:
# retrieve, rerank, final, variations, hypothetical answer, dense weight, sparse weight.
QUERY_PLANS = {
    "yes_no": (200, 20, 5, 1, False, 0.85, 0.15),
    "factual": (500, 50, 15, 2, True, 0.75, 0.25),
    "condition": (600, 60, 20, 3, True, 0.75, 0.25),
    "procedure": (600, 60, 20, 2, True, 0.80, 0.20),
    "scenario": (1000, 80, 25, 4, True, 0.70, 0.30),
    "multi_article": (1000, 80, 25, 4, True, 0.70, 0.30),
    "interpretation": (800, 70, 20, 3, True, 0.90, 0.10),
    "comparison": (1000, 80, 30, 4, True, 0.70, 0.30),
}

# Order in which a reply is searched for the kinds of questions.
QUERY_KINDS = ["yes_no", "factual", "multi_article", "interpretation", "procedure", "comparison", "condition", "scenario"]

# Forms of references that lead to further retrieval; group 1 is the query.
CROSS_REFERENCES = [
    r"(?:theo|tại|quy định tại|căn cứ)\s+(Điều\s+\d+[^.]*?)(?:\s+của|\s+Luật|\s+Nghị|\s+Thông|$)",
    r"(Nghị định\s+\d+/\d+/NĐ-\w+[^.]*?Điều\s+\d+)",
    r"(Thông tư\s+\d+/\d+/TT-\w+[^.]*?Điều\s+\d+)",
    r"(Luật\s+\d+/\d+/QH\d+[^.]*?Điều\s+\d+)",
]

# Marks of an article and of a chapter that sections start at, and the title in front of a section.
ARTICLE_START = r"Điều\s+\d+[.\s]"
CHAPTER_START = r"Chương\s+\w+[.\s]"
SECTION_TITLE = r"^(Điều\s+\d+[^.]*?\.|Chương\s+\w+[^.]*?\.|Mục\s+\w+[^.]*?\.)"

# The code and the type in the source note of a codified article.
NOTE_CODE = r"số\s+(\d+/\d+/[\w-]+)"
NOTE_TYPE = "(Luật|Bộ luật|Nghị định|Thông tư|Pháp lệnh|Nghị quyết|Hiến pháp)"

# What marks a question about named articles or documents, and what a question about terms or rules.
KEYWORD_QUESTION = r"điều\s+\d+|luật\s+|nghị định\s+|thông tư\s+"
RULE_QUESTION = "điều kiện|tiêu chí|khái niệm|quy định|là gì|thế nào"

# Lines in capitals that are no title.
HEADINGS = "CỘNG HÒA|Số:|Căn cứ"

# Types that a title may start with, and those that a lower-cased name may start with.
TITLE_TYPES = ["Luật", "Bộ luật", "Nghị định", "Thông tư", "Quyết định", "Chỉ thị"]
NAME_TYPES = ["bộ luật", "luật", "nghị định", "thông tư liên tịch", "thông tư", "quyết định", "chỉ thị", "nghị quyết", "pháp lệnh"]
