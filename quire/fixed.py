"""Patterns, word lists and limits that results depend on."""

# Numbers of chapters and sections.
CN_NUM = "[一二三四五六七八九十百零〇]+"
CN_OR_AR = rf"(?:{CN_NUM}|\d{{1,3}})"
CN_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100}

# Headings.
CHAPTER = rf"^\s*[·•]?\s*第\s*{CN_OR_AR}\s*章\s+\S"
CHAPTER_BARE = r"^\s*\d{1,2}\s+[^\d\s～~].{0,20}$"
SECTION = rf"^\s*第\s*{CN_OR_AR}\s*节\s+\S"
DOTTED = r"^\s*(\d+)\.(\d+)(\.\d+)?\s+\S"
LISTED = rf"^\s*{CN_NUM}、\S"
BRACKETED = rf"^\s*[（(]\s*{CN_OR_AR}\s*[）)]\s*\S"
BOARD = r"^\s*(思考与练习|习题|上机训练题|内容提要|本章内容提要|参考答案|知识拓展|知识链接|SPSS软件应用提要|附录|索引|参考文献|目录|目\s*录)\s*[一二三四五六七八九十\d]*\s*$"
HASHES = r"^#{1,6}\s*"

# Tables of contents.
TOC_STRICT = rf"^\s*(?:第\s*{CN_OR_AR}\s*章|\d+(?:\.\d+)*)\s*\S.*(?:（\d+）|\(\d+\)|\d+)\s*$"
TOC_NUMBERED = rf"^(?:第\s*{CN_OR_AR}\s*章|\d+(?:\.\d+)*)\s*\S"
TOC_PAGE_TAIL = r"(?:[（(]\s*\d+\s*[）)]|\d+)\s*$"
TOC_BODY_CHARS = 60
TOC_PAGE_SHARE = 0.5
TOC_LEAST_ENTRIES = 3
TOC_ANCHORS = ["目录", "目 录", "目　录"]
HASH_STYLE_LEAST = 3
ENTRY = rf"^第\s*({CN_OR_AR})\s*[章篇]\s*(.*)$"
ENTRY_PAGE = r"(?:[（(]?\s*(\d+)\s*[）)]?|\.{2,}\s*(\d+))\s*$"
BODY_CHAPTER = rf"^#+\s*第\s*{CN_OR_AR}\s*章"
CHAPTER_TITLE = rf"^第\s*({CN_OR_AR})\s*章\s*(.*)$"
SECTION_NO = rf"^第\s*({CN_OR_AR})\s*节"

# Tables and images.
IMAGE_MD = r"!\[[^\]]*\]\([^)]*\)"
IMAGE_REF = r"!\[[^\]]*\]\((images/[^)\s]+)\)|<img\s+[^>]*src=[\"'](images/[^\"']+)[\"'][^>]*>"
TABLE_COLS = (2, 8)
TABLE_ROWS = (2, 20)
TABLE_CELL_CHARS = 300

# Catalogue and parsing.
STATES = ["pending", "parsing", "parsed", "structure_ok", "failed"]
BATCH_PAGES = 25
BATCH_PAGES_FREE = 20
DAILY_PAGES = 1000
DAILY_FILES = 5000
BACKUPS_KEPT = 3
OUTLINE_ORPHANS = 20
ERRORS_SHOWN = 5
MIME = {".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".svg": "image/svg+xml", ".jpeg": "image/jpeg", ".jpg": "image/jpeg"}
MIME_OTHER = "image/jpeg"
