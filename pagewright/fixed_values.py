"""Word lists, lookup tables, patterns, prompts and labels.

Everything in this module is data that must be exactly these values for results
to come out right.  No logic lives here.
"""

# --- character classes (bodies of a regex [...] class) -----------------------
# The outer range in the CJK classes rejects Latin text with one comparison.

# Every code point that counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\p{IsWhite_Space}\x1C-\x1F"
LINE_BREAK = r"\n\x0B\f\r\x1C\x1D\x1E\x{85}\x{2028}-\x{2029}"
HAN = r"\x{2E80}-\x{FAFF}&&[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
KANA = r"\x{3040}-\x{30FF}"
HANGUL = r"\x{1100}-\x{D7AF}&&[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"
CJK = (
    r"\x{2E80}-\x{FAFF}&&"
    r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
)

# --- line and page rules ------------------------------------------------------

SKIP_HEADINGS = (
    "references", "bibliography", "table of contents", "contents",
    "acknowledgements", "acknowledgement", "acknowledgments", "acknowledgment",
    "參考文獻", "參考資料", "目錄", "目次", "致謝", "誌謝",
)
SENTENCE_MIN_CJK = 8
SENTENCE_MIN_WORDS = 5
CJK_PAGE_RATIO = 0.2
MIN_PAGE_CHARS = 120
MIN_PAGE_CHARS_CJK = 60
MIN_PROSE_LINES = 3
MIN_PROSE_SHARE = 0.35
MIN_PROSE_SHARE_CJK = 0.2
OCR_MIN_CHARS = 40
SENTENCE_END = ".!?。！？"

# --- language -----------------------------------------------------------------

KANA_SHARE = 0.02
HANGUL_SHARE = 0.05
HAN_SHARE = 0.05

LANGUAGE_NAMES = {
    "zho_Hant": "正體中文（繁體）",
    "zho_Hans": "簡體中文",
    "eng_Latn": "English",
    "jpn_Jpan": "日本語",
    "kor_Hang": "한국어",
}
ISO_BY_PREFIX = {
    "zho": "zh", "eng": "en", "jpn": "ja", "kor": "ko",
    "fra": "fr", "deu": "de", "spa": "es", "rus": "ru",
}
MODEL_CODE_BY_ISO = {
    "zh": "zho_Hans", "en": "eng_Latn", "ja": "jpn_Jpan", "ko": "kor_Hang",
    "fr": "fra_Latn", "de": "deu_Latn", "es": "spa_Latn", "ru": "rus_Cyrl",
}

# --- keywords -----------------------------------------------------------------

WORD = r"[A-Za-z][A-Za-z\-]{2,}"
TOP_KEYWORDS = 60
SHOWN_KEYWORDS = 30
STOP_WORDS = (
    "the and for are but not you all can her was one our out has had him his how man new now old see "
    "two way who boy did its let put say she too use with this that from they will would there their "
    "what which when were have been more also than then them these such into only other some could "
    "about using used each both between over under while where here very most may we is in on of to as "
    "by an or be at it if so do no up figure table et al eq section"
).split()

# --- packing ------------------------------------------------------------------

CHUNK_CHARS = 6000
WINDOW_CHARS = 1400

# --- prompts and budgets --------------------------------------------------------

SUMMARY_SYSTEM = (
    "你是專業的技術文件摘要助手。請用**正體中文（繁體）**，"
    "以條列方式精煉重點，忠於原文、不杜撰，不要加入開場白。"
)
SUMMARY_PREFIX = "請摘要以下內容的重點：\n\n"
SUMMARY_TOKENS = 900
OVERVIEW_SYSTEM = (
    "你是專業的技術文件摘要助手。請用**正體中文（繁體）**，"
    "將多段分頁摘要彙整為四個面向：結論、關鍵數據、風險/限制、行動建議。"
    "以標題 + 條列呈現，忠於原文、不杜撰。"
)
OVERVIEW_PREFIX = "以下是各段落摘要，請彙整成全局重點：\n\n"
OVERVIEW_TOKENS = 1400
TRANSLATE_SYSTEM = (
    "你是專業技術文件翻譯，將內容忠實譯成{name}。嚴格遵守：\n"
    "1. 人名、作者名、機構名保留英文原樣，不翻譯也不音譯（例：Haoran Wei）。\n"
    "2. 模型、演算法、專有名詞與縮寫保留原文，必要時中英並陳（例：DeepEncoder V2、LLM、VLMs）。\n"
    "3. 必須翻成{name}，禁止原封不動輸出原文；用詞精準、依上下文選正確詞義、術語前後一致。\n"
    "4. 只輸出譯文本身，不要任何說明、開場白或標註。"
)
TRANSLATE_MAX_TOKENS = 2048
TRANSLATE_EXTRA_TOKENS = 500
SUMMARY_TEMPERATURE = 0.3
TRANSLATE_TEMPERATURE = 0.2

# Budgets and limits of the command-line variant.
SCRIPT_SUMMARY_TOKENS = 400
SCRIPT_OVERVIEW_TOKENS = 700
SCRIPT_TRANSLATE_EXTRA_TOKENS = 400
SCRIPT_PREVIEW_CHARS = 160
SCRIPT_TRANSLATE_CHARS = 1500
SCRIPT_MAX_CHUNKS = 3

# --- four-part overview -----------------------------------------------------------

HEADING_NOISE = r"[#*`>~\-\s:：.。,，、()（）\[\]0-9/／\\|]"
HEADINGS = {
    "結論": "conclusion", "總結": "conclusion",
    "關鍵數據": "data", "鍵數據": "data", "數據": "data", "關鍵資料": "data",
    "風險限制": "risk", "風險": "risk", "限制": "risk", "風險與限制": "risk", "限制與風險": "risk",
    "行動建議": "action", "建議": "action", "後續建議": "action", "行動": "action",
}
PARTS = ("conclusion", "data", "risk", "action")

# --- report ------------------------------------------------------------------------

CLIP_CHARS = 700
CLIP_STOPS = (". ", "。", "! ", "? ", "\n")
REPORT_TITLE = "PDF 摘要 + 翻譯報告"
REPORT_OVERVIEW = "全局重點"
REPORT_PART_NAMES = {"conclusion": "結論", "data": "關鍵數據", "risk": "風險/限制", "action": "行動建議"}
REPORT_WORDCLOUD = "關鍵字文字雲"
REPORT_SEGMENTS = "逐段對照"
REPORT_SUMMARY = "摘要"
REPORT_TRANSLATED = "譯文"
REPORT_ORIGINAL = "原文"
REPORT_NOTHING = "（此段未啟用摘要／翻譯，僅顯示原文）"
IMAGE_PREFIX = "data:image/png;base64,"

# --- progress events -----------------------------------------------------------------

STEP_EXTRACT = 3
STEP_EXTRACTED = 15
STEP_SKIP_TRANSLATION = 16
STEP_SEGMENT_SPAN = 75
STEP_OVERVIEW = 90
STEP_KEYWORDS = 93
STEP_REPORT = 97
STEP_END = 100
MSG_EXTRACT = "開始擷取 PDF 文字（掃描頁自動 OCR）"
MSG_EXTRACTED = "擷取完成：%d 頁 → 有效內容 %d 段"
MSG_NO_TEXT = "PDF 未擷取到有效文字（OCR 後仍無內容，可能是空白或非文字文件）"
MSG_SKIP_TRANSLATION = "原文已是目標語言（%s），略過翻譯"
MSG_SEGMENT = "完成第 %d/%d 段"
MSG_OVERVIEW = "彙整全局重點"
MSG_KEYWORDS = "提取關鍵字並產生文字雲"
MSG_REPORT = "產生 PDF 報告"
MSG_DONE = "分析完成"
MSG_FAILED = "處理失敗：%s"
MSG_CACHE_HIT = "快取命中"

# --- service -----------------------------------------------------------------------------

MODEL = "qwen3.5:4b"
WINDOW_TRANSLATOR = "qwen"
TARGET_LANGUAGE = "zho_Hant"
SOURCE_LANGUAGE = "eng_Latn"
FEATURES = "summary,translate,wordcloud,report"
UPLOAD_MAX_MB = 50
HISTORY_LIMIT = 200
