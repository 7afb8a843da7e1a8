"""Word lists, patterns and weights that decide results.  All are parameters of the functions that use them."""

# Structural signals (weight, pattern on lower-case text).
SIGNALS = [
    (30, r"```|`[^`]+`"),
    (25, r"error|exception|bug|报错|失败"),
    (20, r"决定|采用|chosen|will use|就用"),
    (18, r"config|host|port|key|secret|配置"),
    (15, r"https?://|www\."),
    (12, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    (10, r"问题|question|如何|怎么|why"),
    (-15, r"^(好的|ok|嗯|👍|谢谢|got it|嗯嗯|哦哦)$"),
    (-10, r"^(好|是|对|ok)$"),
]

# Message classes in order of precedence (pattern on lower-case text).
CLASSES = [
    ("decision", r"决定|采用|chosen|will use|就用|确定"),
    ("error", r"error|exception|bug|报错|失败"),
    ("config", r"config|host|port|\bkey\b|\bsecret\b|配置|设置"),
    ("code", r"```|`[^`]+`|function|def |class "),
    ("question", r"\?|？|如何|怎么|为什么|why|how"),
]
CHITCHAT = r"^(好的|ok|嗯|👍|谢谢|got it|嗯嗯|哦哦|好|是|对)$"
EXEMPT = ["decision", "config", "code", "error"]

# Base half-life of a class in days.
HALF_LIFE_DAYS = {"decision": 90.0, "config": 120.0, "code": 60.0, "error": 30.0, "chitchat": 3.0, "question": 7.0, "fact": 14.0, "unknown": 14.0}

# Words that mark what a user wants.
INTENTS = {
    "question": "吗[？?]|是否|有没有|怎么样|如何|什么|为什么|怎么",
    "request": "帮(我|你)|给我|看看|检查|配置|安装|修复|优化",
    "confirmation": "好的|可以|行|嗯|是的|对|记住了",
    "complaint": "还是|又|一直|重复|卡顿|问题",
}
# Words that mark what an assistant concludes.
CONCLUSIONS = {
    "decision": "决定|选择|采用|方案",
    "error": "错误|失败|问题|bug|异常",
    "next_step": "下一步|接下来|然后|需要",
    "result": "完成|成功|已经|解决了|修复了",
}
# Entity mentions (versions, files, paths).
ENTITY_PATTERNS = [r"v[0-9]+\.[0-9]+\.[0-9]+", r"v[0-9]+\.[0-9]+", r"[0-9]+\.[0-9]+\.[0-9]+", r"[A-Za-z0-9_\-]+\.(?:py|ts|js|json|md)", r"[A-Za-z0-9_\-]+/[A-Za-z0-9_\-]+"]

# Words that deny or replace.
NEGATIONS = ["不(用|要|采用|使用|选择)", "改(用|为|成)", "放弃|弃用|替换|迁移到", "don't use|switch to|replace|migrate to|no longer"]
CLAIM_WORDS = r"[A-Z][a-zA-Z]+|[a-z]{3,}(?:\s+[0-9]+\.[0-9]+)?|[一-鿿]{2,4}"

# Repeated scaffolding in system messages.
BOILERPLATE = [r"\[MEMORY REMINDER\][^\n]*", r"<system-reminder>[^\n]*</system-reminder>", r"Current Date:[^\n]*"]

# Goals with these words make no skill.
SKIP_WORDS = ["你好", "hello", "hi", "嗨", "谢谢", "thank", "thanks", "闲聊", "chitchat", "small talk", "测试", "test", "再见", "bye", "天气", "今天多少度"]

# Importance of keywords.
IMPORTANCE = [
    ("决定|决策|选择|确定|确认|同意|批准|执行|实施", 100),
    ("最终方案|选定|采用|启用|关闭|禁用", 95),
    ("错误|失败|异常|崩溃|超时|拒绝", 90),
    ("警告|告警|问题|bug|缺陷|故障", 85),
    ("修复|解决|恢复|回滚", 80),
    ("配置|设置|参数|选项|环境|变量", 85),
    ("安装|部署|更新|升级|卸载", 80),
    ("API|密钥|token|密码|认证", 90),
    ("偏好|喜欢|希望|想要|需要|要求", 80),
    ("习惯|风格|方式|格式|模式", 75),
    ("怎么|如何|为什么|是否|能不能", 70),
    ("什么|哪个|哪里|何时|谁", 65),
]

# Seven classes by keywords, in order of precedence.
SEVEN_CLASSES = [
    ("decision", "决定|决策|选择|确定|确认|同意|批准|最终"),
    ("error", "错误|失败|异常|崩溃|超时|修复|解决"),
    ("config", "配置|设置|参数|安装|部署|API|密钥"),
    ("preference", "偏好|喜欢|希望|想要|需要|要求"),
    ("question", "怎么|如何|为什么|是否|什么|哪个"),
    ("chitchat", "哈哈|嘿嘿|嗯|哦|随便|都行"),
]

# Ten classes with weight and keywords (in lower-case text), in order of precedence.
TEN_CLASSES = [
    ("decision", 100, ["决定", "decision", "选择", "确定", "就用"]),
    ("error", 90, ["错误", "error", "失败", "bug", "问题"]),
    ("config", 85, ["配置", "config", "设置", "api key", "环境变量"]),
    ("preference", 80, ["偏好", "喜欢", "prefer", "习惯"]),
    ("question", 70, ["问题", "怎么", "如何", "为什么", "?"]),
    ("fact", 60, ["事实", "fact", "信息", "数据"]),
    ("action", 50, ["执行", "运行", "action", "完成"]),
    ("feedback", 45, ["反馈", "建议", "feedback"]),
    ("context", 30, ["上下文", "背景", "context"]),
    ("chitchat", 10, ["哈哈", "好的", "嗯嗯", "哦"]),
]

# Additive keyword weights.
KEYWORD_WEIGHTS = {
    "decision": (0.3, ["决定", "方案", "选择", "决定采用", "decide", "choose"]),
    "error": (0.25, ["错误", "失败", "异常", "error", "fail", "exception"]),
    "config": (0.2, ["配置", "设置", "更新", "config", "setting", "update"]),
    "preference": (0.15, ["偏好", "喜欢", "希望", "prefer", "like", "want"]),
}

# Words before which an entity stands.
DECISION_WORDS = ["决定", "选择", "配置", "设置", "采用", "使用", "改为", "切换"]
ROLE_DECISION_WORDS = ["决定", "采用", "选择", "方案", "确定", "decided", "will use", "chosen"]

# Tokens of a Chinese character by provider.
PROVIDER_CJK = {"deepseek": 1.2, "zhipu": 1.2, "glm": 1.2, "wenxin": 1.2, "qwen": 1.2, "claude": 2.0, "anthropic": 2.0, "gemini": 1.5, "google": 1.5, "openai": 1.5, "gpt": 1.5, "mistral": 1.5, "default": 1.5}

# Facts of tool results (paths; numbers with their label; errors; success).
FACT_PATHS = [r"/[a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+", r"[A-Z]:\\[a-zA-Z0-9_\-\\]+\.[a-zA-Z0-9]+", r"(?:path|file|filepath)[:\s]+([^\s,]+)"]
FACT_NUMBERS = [
    (r"(\d+(?:\.\d+)?)\s*lines?", "lines"), (r"(\d+(?:\.\d+)?)\s*bytes?", "bytes"), (r"(\d+(?:\.\d+)?)\s*KB", "size"), (r"(\d+(?:\.\d+)?)\s*MB", "size"),
    (r"(\d+(?:\.\d+)?)\s*seconds?", "duration"), (r"(\d+(?:\.\d+)?)\s*ms", "duration"), (r"(\d+(?:\.\d+)?)\s*(?:hits?|matches?)", "matches"), (r"found\s+(\d+)", "count"), (r"returned\s+(\d+)", "count"),
]
FACT_ERRORS = [r"(error|exception|failed|timeout)", r"(?:Error|Exception|Failed|Timeout):\s*([^\n]+)"]
FACT_SUCCESS = r"success|succeeded|completed|done|ok"

# What a quality check looks for (decisions, settings).
GUARD_DECISIONS = ["决定", "采用", "选择", "使用", "方案", "chosed", "will use", "decided", "selected", "option", "solution", "final"]
GUARD_SETTINGS = ["配置", "设置", "参数", "环境变量", "config", "setting", "parameter", "env", "variable", "API_KEY", "token"]
