"""Fixed values that must equal the digest rules for results to match.

Everything here is stated as plain data in its natural order; operators build
their column expressions from these lists.
"""

# --- fixed values: digest topic keywords (substring hits, quirk Q1) ---
AI_KEYWORDS = (
    "ai", "llm", "agent", "agents", "openai", "anthropic", "claude", "gpt", "gemini", "deepseek",
    "grok", "cursor", "copilot", "qwen", "microsoft", "google", "meta", "xai", "nvidia", "inference",
    "training", "fine-tuning", "gpu", "rag", "mcp", "model", "models", "prompt", "coding", "code",
    "机器人", "智能体", "模型", "推理", "训练", "编程", "代码", "算力", "芯片", "开源", "工作流",
)

# --- fixed values: builder-post signal keywords ---
SIGNAL_KEYWORDS = (
    "ai", "agent", "agents", "llm", "model", "models", "claude", "openai", "anthropic", "gemini",
    "gpt", "grok", "mistral", "qwen", "deepseek", "fable", "mythos", "cursor", "codex", "copilot",
    "replit", "v0", "vercel", "mcp", "rag", "inference", "eval", "benchmark", "open source",
    "workflow", "workflows", "coding", "code", "review", "security", "growth agent", "skill", "skills",
    "sandbox", "server", "function", "runtime", "api", "apis", "deploy", "deployment", "tool", "tools",
    "product", "engineering", "developer", "devtool", "infra", "architecture", "automation", "orchestration",
    "regulation", "regulatory", "fda", "government", "policy", "ban", "safety",
)

# --- fixed values: builder-post low-signal patterns (lower-case substrings) ---
NOISE_PATTERNS = (
    "touch grass",
    "best dinner",
    "michelin",
    "followers on x",
    "reached 70k",
    "don't ignore your dms",
    "dms on linkedin",
    "this is great ux",
    "so intuitive",
    "attention is all you need",
    "wanted to buy a new mac",
    "is this a loop",
    "who needs fable when you can have mistral’s le chaton fat",
    "who needs fable when you can have mistral's le chaton fat",
    "want unreleased",
    "trusted tester",
    "sign up here",
)

# --- fixed values: priority weights ---
CONFIDENCE_POINTS = {"high": 18, "medium": 10, "low": 4}
KIND_POINTS = {
    "article_candidate": 16,
    "aihot_item": 18,
    "rss_article": 15,
    "blog_post": 14,
    "podcast_episode": 10,
    "tweet": 6,
    "newsletter": 14,
    "rss_entry": 12,
}
KIND_POINTS_DEFAULT = 8
STATUS_PENALTY = {"deferred_rate_limited": 10, "summary_only": 20, "needs_deep_read": 35}

# --- fixed values: digest sources, in report order ---
DIGEST_SOURCES = ("rss", "email", "follow-builders", "bestblogs", "ak-rss-digest", "aihot")
BREAKING_SOURCES = ("rss", "email", "aihot")
DEEP_SOURCES = ("bestblogs", "follow-builders", "ak-rss-digest")

# --- fixed values: cache file names per source ---
RAW_CACHE_FILES = {
    "email-raw.json": "email",
    "rss-raw.json": "rss",
    "external-skills.json": "external_skills",
    "websites.json": "websites",
    "follow-builders.json": "follow-builders",
    "bestblogs.json": "bestblogs",
    "ak-rss.json": "ak-rss-digest",
    "ak-rss-raw.json": "ak-rss-digest",
    "aihot.json": "aihot",
    "aihot-raw.json": "aihot",
}
NORMALIZED_CACHE_FILES = {
    "follow-builders-normalized.json": "follow-builders",
    "bestblogs-normalized.json": "bestblogs",
    "ak-rss-digest-normalized.json": "ak-rss-digest",
    "aihot-normalized.json": "aihot",
    "external-skills-normalized.json": "external_skills",
}
MANIFEST_FILES = ("run-manifest.json", "run-metadata.json")
HEAVY_SOURCES = ("follow-builders", "bestblogs", "ak-rss-digest", "aihot")
EXTERNAL_GROUP_MEMBERS = ("follow-builders", "bestblogs", "ak-rss-digest")
GROUP_SOURCES = ("rss", "email", "external_skills", "websites")
ALL_RUN_SOURCES = GROUP_SOURCES + HEAVY_SOURCES
MANIFEST_COMPLETE_STATUSES = ("complete", "completed", "ready")

# --- fixed values: task service ---
LOCAL_ZONE = "Asia/Shanghai"   # Beijing time, fixed +08:00
PRIORITY_GLYPHS = {0: " ", 1: "↓", 3: "→", 5: "↑"}
INBOX_LABEL = "📥 收件箱"
POMODORO_MINUTES = 25
REQUEST_LIMIT_PER_MINUTE = 100

# --- fixed values: windows and caps ---
PER_SOURCE_LIMIT = 8
OVERALL_LIMIT = 18
DEDUP_WINDOW_DAYS = 14
RETENTION_DAYS = 21

# --- fixed values: freshness conclusions of the source-freshness check ---
VERDICT_NO_HARD_7D = "硬新闻来源（rss/email/aihot）没有最近 7 天的新内容。今天不应强写主线新闻，应转为“无明显新硬新闻 + 深读分析/趋势判断”。"
VERDICT_NO_HARD_48H = "硬新闻来源没有 48 小时内的新内容；如果继续写日报，必须把内容表述为最近几天的延续，而不是今天新发布。"
VERDICT_DEEP_NEWER = "深读来源（如 BestBlogs）比硬新闻来源更新，版面应允许新深读上浮，或明确说明“今天主线新闻偏少，本期以高价值深读为主”。"
VERDICT_OK = "硬新闻来源与深读来源都存在较新的内容，可以正常进入写稿阶段，但仍需做跨天去重。"

# --- fixed values: compact-report warnings and limitations ---
WARN_NO_HARD_7D = "硬新闻来源（rss/email/aihot）没有最近 7 天内的新条目；如果仍要成稿，应明确写成“今天硬新闻偏少”，并转为分析/深读视角。"
WARN_NO_HARD_48H = "硬新闻来源没有 48 小时内的新条目；若引用最近几天的 newsletter / AI HOT 条目，必须标注为最近几天的延续，不要冒充当天新主线。"
WARN_DEEP_NEWER = "BestBlogs/深读来源比硬新闻来源更新；版面上应允许高价值新深读上浮，或明确说明“主线新闻偏少，本期以深读为主”。"
LIMIT_RSS_MISSING = "RSS 缓存缺失或不可读。"
LIMIT_RSS_ERRORS = "RSS 有 {n} 个 feed 抓取/解析失败。"
LIMIT_EMAIL_MISSING = "Email 缓存缺失或当日未抓到邮件。"
LIMIT_BB_RATE = "BestBlogs 有 {n} 条 deep-read 命中限流，已保留候选但降低优先级。"
LIMIT_BB_FOLLOWUP = "BestBlogs 仍有 {n} 条需要后续补抓或人工确认。"
LIMIT_AK_ERRORS = "AK RSS Digest 上游有 {n} 个 feed 报错，但其余条目已保留。"
LIMIT_FB_TWEETS = "follow-builders 含大量 X 动态，已按 AI 相关性和互动信号压缩，不保留低信噪比 tweet dump。"
LIMIT_HOT_MODE = "AI HOT 已按 {mode} 模式和目标日期过滤，items API 最多覆盖最近 7 天。"
LIMIT_HOT_DROPPED = "AI HOT 有 {n} 条因日期或字段不完整被过滤。"
UNTITLED = "未命名条目"
NO_LIMITS = "- 无明显限制。"
NO_CANDIDATES = "- 无候选条目。"
HEAD_STATS = "## 来源统计"
HEAD_FRESHNESS = "## 新鲜度检查"
HEAD_CONCLUSIONS = "## 新鲜度结论"
HEAD_LIMITS = "## 来源限制 / 风险"
HEAD_CANDIDATES = "## 候选条目（按来源压缩）"
HEAD_OVERALL = "## 跨来源优先关注"
LINK_LABEL = "链接"

# --- fixed values: partial-run reasons and actions ---
REASON_RAW_NOTE_MISSING = "已存在缓存，但原始稿缺失"
REASON_SUMMARY_MISSING = "原始稿已存在，但摘要稿缺失"
REASON_SUMMARY_NOT_BUILT = "已存在缓存，但摘要稿尚未生成"
REASON_RAW_ONLY = "{source} 只有 raw cache，尚未完成 normalization"
REASON_NORMALIZED_ONLY = "{source} 只有 normalized 文件，缺少 raw cache"
ACTION_FRESH = "fresh_run"
ACTION_INCREMENTAL = "ask_user_incremental_or_overwrite"
ACTION_EXISTING = "ask_user_use_existing_or_overwrite"

# --- own rules: editorial noise patterns (ads, hiring, subscriptions) ---
EDITORIAL_NOISE_PATTERNS = (
    ("ad", r"\b(sponsored|advertisement|promoted|partner content)\b"),
    ("hiring", r"\b(we are hiring|we're hiring|join our team|open positions?)\b"),
    ("subscription", r"\b(confirm your subscription|welcome to|thanks for subscribing|unsubscribe)\b"),
)
TEASER_MAX_WORDS = 12          # a link-less item shorter than this is a vague teaser

# --- fixed values: section caps and thresholds ---
INDUSTRY_MIN, INDUSTRY_CAP = 8, 4
PERSONAL_MIN, PERSONAL_CAP = 7, 5
WATCH_CAP = 15
CONTINUATION_PENALTY = 2
HEADLINE_LOOKBACK_DAYS = 3

# --- own rule: headings a note must have ---
REQUIRED_HEADINGS = ("# ", "## ")

# --- fixed values: statistics fields of each source's normaliser ---
NORMALIZE_STATS = {
    "bestblogs": ("candidate_count", "normalized_items", "dropped_items", "items_with_direct_url", "items_needing_followup",
                  "deep_read_attempted", "deep_read_completed", "deep_read_rate_limited"),
    "follow-builders": ("normalized_items", "dropped_items", "podcast_items", "tweet_items", "blog_items"),
    "ak-rss-digest": ("normalized_items", "dropped_items", "upstream_errors"),
    "aihot": ("normalized_items", "dropped_items", "items_with_direct_url", "selected_items"),
}
