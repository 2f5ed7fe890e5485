"""Fixed values shared by the whole package.

Everything in this file is a value that results are compared on: status names,
labels, messages, limits and the prompt text.  No logic lives here.
"""

# Defaults of the document pipeline and of retrieval.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
TOP_K = 3

# File types accepted for upload.
SUPPORTED_TYPES = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt")

# Document statuses and the label shown for each of them.
STATUS_LABELS = {
    "UPLOADING": "上传中",
    "UPLOAD_FAILED": "上传失败",
    "PARSING": "解析中",
    "PARSE_FAILED": "解析失败",
    "CHUNKING": "切片中",
    "CHUNK_FAILED": "切片失败",
    "EMBEDDING": "向量化中",
    "EMBEDDING_FAILED": "向量化失败",
    "COMPLETED": "已完成",
    "FAILED": "失败",
}
IN_PROGRESS_STATUSES = ("UPLOADING", "PARSING", "CHUNKING", "EMBEDDING")

# Progress reached when a stage begins.
STAGE_PROGRESS = {
    "UPLOADING": 10,
    "PARSING": 30,
    "CHUNKING": 50,
    "EMBEDDING": 70,
    "COMPLETED": 100,
}

# Messages stored with documents, uploads and knowledge bases.
MSG_KB_MISSING = "知识库不存在: "
MSG_DOCUMENT_MISSING = "文档不存在: "
MSG_KB_NAME_EXISTS = "知识库名称已存在: "
MSG_TYPE_UNSUPPORTED = "不支持的文件类型: "
MSG_TYPE_HINT = "，仅支持 PDF、DOC、DOCX、XLS、XLSX、PPT、PPTX、TXT"
MSG_FILE_EXISTS = "文件已存在: "
MSG_NO_TEXT = "无法从文档中提取文字"
MSG_ALL_CHUNKS_FAILED = "所有切片向量化失败"
MSG_SOME_CHUNKS_FAILED = "部分切片向量化失败，成功: "
MSG_SOME_CHUNKS_FAILED_2 = ", 失败: "

# Answers given without the model's text.
ANSWER_NO_DOCUMENTS = "该知识库暂无文档，请先上传文档。"
ANSWER_NO_BALANCE = "AI服务余额不足，请联系管理员充值后继续使用。"
ANSWER_UNAVAILABLE = "抱歉，AI服务暂时不可用，请稍后重试。"
BALANCE_ERROR_MARKS = ("insufficient_balance", "insufficient balance", "1008")

# Layout of a context.
CONTEXT_HEAD = "参考文档：\n\n"
CONTEXT_ITEM_OPEN = "【文档"
CONTEXT_ITEM_CLOSE = "】\n"
CONTEXT_ITEM_END = "\n\n"

# The prompt, in the three parts around context and question.
PROMPT_HEAD = (
    "你是一个专业的智能问答助手，擅长从提供的文档中准确提取信息并清晰回答用户问题。\n"
    "\n"
    "=== 参考文档 ===\n"
)
PROMPT_QUESTION = (
    "\n"
    "\n"
    "=== 用户问题 ===\n"
)
PROMPT_TAIL = (
    "\n"
    "\n"
    "=== 回答要求 ===\n"
    "1. 只基于参考文档内容回答，不要编造信息\n"
    '2. 如果文档中没有相关信息，回答："抱歉，知识库中没有找到与您问题相关的内容。"\n'
    "3. 引用文档时使用【文档X】标注来源\n"
    "4. 回答结构：先给出结论，再引用证据，最后补充说明（如有）\n"
    "5. 对于复杂问题，用分点或编号的方式回答\n"
    "\n"
    "=== 回答 ===\n"
)

# Section of the history-aware prompt (own wording; only the idea is specified).
HISTORY_HEAD = "\n\n=== 对话历史 ===\n"

# Session titles.
TITLE_LENGTH = 20
TITLE_MORE = "..."

# Characters up to U+0020, which trimming removes.
TRIM_CHARS = "".join(chr(c) for c in range(0x21))

# Characters that make a text blank (white space without the
# no-break spaces, plus the separators U+001C to U+001F).
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
    "\u2028\u2029\u205f\u3000"
)

# Canonical text form of a UUID.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
