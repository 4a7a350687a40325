"""Rule tables as data, and the expressions that apply them: first match or all matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.scalars import let

Rules = Sequence[tuple[str, str]]

# Labels and patterns of the archive's rule sets. Patterns ignore case.
SIGNALS: Rules = (
    ("AI/技术", "ai|llm|prompt|模型|代码|算法|开发|架构|接口|数据|python|typescript|react|openai|claude|数据库|工程|部署|调试"),
    ("哲理/方法", "哲学|意义|价值|原则|方法|思考|复盘|成长|判断|选择|长期|系统|认知|心态"),
    ("学业", "课程|考试|复习|基医|强基|医学|学分|作业|实验|高数|化学|英语|解剖|生物|病理"),
    ("创业/项目", "创业|商业|产品|用户|市场|融资|项目|计划|需求|运营|商业模式|增长"),
    ("比赛", "比赛|竞赛|挑战杯|大创|建模|赛题|路演"),
    ("生活/关系", "朋友|关系|沟通|家庭|生活|情绪|压力|喜欢|老师|同学"),
)
NO_SIGNAL = "一般内容"
INSIGHT_CATEGORIES: Rules = (
    ("AI", r"\b(?:AI|GPT|Claude|Gemini|DeepSeek|Codex|Agent|Skills?)\b|模型|人工智能"),
    ("比赛", "比赛|竞赛|答辩|大创|国创|锦兰杯|正大杯"),
    ("创业", "创业|项目|商业|变现|定价|客户|交付"),
    ("学业", "课程|考试|期末|论文|科研|六级|作业|组会"),
    ("专业", "医学|临床|基础医学|病理|生理|解剖"),
    ("资源工具", "工具|教程|软件|飞书|Obsidian|剪辑|服务器"),
    ("技术", "代码|编程|Python|API|部署|GitHub|数据库|DNS"),
    ("健康", "健康|感冒|体测|BMI|肺活量|减脂|睡眠"),
    ("财务", "价格|收费|成本|预算|赚钱|付款|报销"),
    ("生活", "旅游|宿舍|租房|吃饭|民宿|生活"),
    ("哲理", "感悟|人生|关系|社交|内耗|复盘|成长"),
)
OTHER = "其他"
ADVICE = "建议|方法|注意|经验|原理|总结|复盘|决定|计划|需要"
FILE_KEYWORDS: Rules = (
    ("AI", r"(^|[^a-z])ai([^a-z]|$)|人工智能|机器学习|深度学习|llm|prompt|gpt|openai|claude|deepseek|大模型|神经网络|agent|多模态|stable\s?diffusion|comfyui"),
    ("比赛", r"比赛|竞赛|挑战杯|互联网\+|大创|数学建模|建模|赛道|路演|答辩|赛|锦兰杯|创新创业大赛"),
    ("创业", "创业|商业计划|bp|融资|商业|公司|产品|市场|运营|增长|获客|简历|resume|offer|求职|校招|实习|内推|生涯|职业规划|教培|项目计划"),
    ("树林", "树林|forest|tree|植物|生态|自然|森林"),
    ("专业", "解剖|生理|生化|组胚|病理|药理|临床|基础医学|医学|科研|论文|课题|实验报告|细胞|免疫|分子|病例"),
    ("学业", "学业|课程|作业|考试|期末|期中|复习|资料|讲义|笔记|真题|基医|强基|hust|华科|高数|微积分|线代|英语|四六级|思政|概率|物理|化学|导论|体育|讲座"),
    ("项目", "roadmap|需求|prd|迭代|架构|方案|里程碑|开发文档|接口文档"),
    ("健康", "体检|病历|睡眠|健身|运动计划|饮食|心理|健康"),
    ("财务", "账单|发票|报销|预算|收入|支出|合同|银行|付款|收款|财务"),
    ("旅行", "旅行|旅游|机票|酒店|行程|车票|攻略"),
    ("阅读", "读书|摘录|读后感|article|paper|book|epub|电子书"),
    ("工具", "脚本|配置|安装|插件|workflow|自动化|教程|指南|手册|cheatsheet"),
    ("人物", "名片|通讯录|联系人|导师|老师同学"),
    ("生活", "照片|日常|家庭|聚会|回忆|生活"),
)
SUBCATEGORIES: Rules = (
    ("聊天影像", r"Pic|Image|Thumb|Ori|\.(png|jpe?g|gif|webp)$"), ("视频", r"Video|\.(mp4|mov|mkv|webm)$"), ("语音", r"Ptt|Audio|Voice|\.(mp3|wav|ogg|silk|amr)$"),
    ("文档/PDF", r"\.(pdf)$"), ("文档/网页", r"\.(html?)$"), ("文档/结构化数据", r"\.(json)$"), ("文档/文本", r"\.(docx?|md|txt)$"), ("文档/演示", r"\.(pptx?)$"), ("文档/表格", r"\.(xlsx?|csv)$"),
    ("代码", r"\.(py|ipynb|js|ts|tsx|cpp|c|h|java|html|css)$"),
)
ARCHIVE_SUBCATEGORY = "压缩包"
FILE_FALLBACK: Rules = (("学业", r"\.(pdf|docx?|pptx?|xlsx?|csv|txt|md)$"), ("过去", r"\.(png|jpe?g|gif|webp|bmp|mp4|mov|mkv|webm|mp3|wav|ogg|silk|amr)$"), ("素材", r"\.(zip|rar|7z)$"))
PREVIEWS: Rules = (
    ("database", r"\.(db|sqlite|sqlite3|db-wal|db-shm)$|/nt_db/"),
    ("image", r"\.(png|jpe?g|gif|webp|bmp|svg|ico|apng|avif)$"), ("video", r"\.(mp4|webm|mov|mkv)$"), ("voice", r"\.(amr|silk)$"), ("audio", r"\.(mp3|wav|ogg)$"),
    ("font", r"\.(ttf|otf|woff2?)$"), ("pdf", r"\.pdf$"), ("docx", r"\.docx$"), ("sheet", r"\.(xlsx?|csv)$"), ("html", r"\.html?$"), ("json", r"\.json$"), ("markdown", r"\.(md|markdown)$"),
    ("text", r"(^|/)(log|log\.old|current|manifest-\d+)$"), ("text", r"\.(txt|log|xml|yml|yaml|toml|ini|cfg|conf|config|plist|pem|key|crt|cer|lic|manifest)$"), ("presentation", r"\.(pptx?|ppsx)$"), ("archive", r"\.(zip|rar|7z)$"), ("code", r"\.(effect|py|ipynb|js|ts|tsx|cpp|c|h|java|css|lua)$"),
)
ASSET_TYPES = {3: "image", 43: "video", 34: "voice"}
ASSET_PREVIEWS: Rules = (
    ("image", r"\.(?:png|jpe?g|gif|webp|bmp|svg|ico|apng|avif)$"), ("video", r"\.(?:mp4|webm|mov|mkv)$"), ("voice", r"\.(?:amr|silk)$"), ("audio", r"\.(?:mp3|wav|ogg|m4a)$"), ("pdf", r"\.pdf$"),
    ("docx", r"\.(?:docx?)$"), ("sheet", r"\.(?:xlsx?|csv)$"), ("presentation", r"\.(?:pptx?|ppsx)$"), ("html", r"\.(?:html?)$"), ("markdown", r"\.(?:md|markdown)$"), ("json", r"\.json$"),
    ("text", r"\.(?:txt|log|xml|ya?ml|toml|ini|cfg|conf)$"), ("archive", r"\.(?:zip|rar|7z)$"), ("code", r"\.(?:py|js|jsx|ts|tsx|css|vue|c|h|cpp|java)$"),
)
HEX_LIKE = r"^[0-9a-f_:\-./\\]{20,}$"
EMPTY_WORDS = "^(true|false|null|undefined|nan|inf)+$"
USEFUL = "message|chat|meeting|wechat|qq|content|http|课程|考试|项目|AI|prompt"

#: A Latin table of the same shape, for tables without Han text.
LATIN_SIGNALS: Rules = (("article", r"(^|\s)(the|der|la)(\s|$)"), ("link", r"(^|\s)(and|und|et)(\s|$)"), ("mail", "@"), ("number", r"\d{2,}"))


def first_match(c: Column, rules: Rules, default: str | None) -> Column:
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(c.rlike(f"(?iu){pattern}"), label).otherwise(out)
    return out


def signals(c: Column, rules: Rules = SIGNALS, default: str = NO_SIGNAL) -> Column:
    """Every label whose pattern occurs, in rule order; the default alone if none does."""
    found = F.array_compact(F.array(*[F.when(c.rlike(f"(?iu){p}"), F.lit(label)) for label, p in rules]))
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(default))))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def preview_for(path: Column) -> Column:
    return first_match(slashed(path), PREVIEWS, "download")


def preview_for_asset(name: Column, kind: Column) -> Column:
    """What shows an asset: its message type settles it, else its extension."""
    by_type = F.coalesce(*[F.when(kind == k, v) for k, v in ASSET_TYPES.items()])
    return F.coalesce(by_type, first_match(name, ASSET_PREVIEWS, "download"))


def classify_file(path: Column, keywords: Rules = FILE_KEYWORDS, default: str = "未归类") -> Column:
    """struct(category, subcategory as a path): keyword rules on the whole path first, then the extension.

    Archives that no keyword names have a subcategory of their own."""
    path = slashed(path)
    by_ext = first_match(path, FILE_FALLBACK, default)
    named = first_match(path, keywords, None)
    packed = named.isNull() & path.rlike(r"(?i)\.(zip|rar|7z)$")
    kind = F.when(packed, ARCHIVE_SUBCATEGORY).otherwise(first_match(path, SUBCATEGORIES, OTHER))
    return F.struct(F.coalesce(named, by_ext).alias("category"), kind.alias("subcategory"))


def duplicate_stem(name: Column) -> Column:
    """struct(key, serial) of `stem(3).ext`: the key without the serial, 0 where there is none."""
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    serial = F.regexp_extract(stem, r"\((\d{1,9})\)$", 1)
    key = F.lower(F.concat(F.trim(F.when(serial != "", F.regexp_replace(stem, r"\(\d+\)$", "")).otherwise(stem)), ext))
    return F.struct(key.alias("key"), F.when(serial != "", serial.cast("long")).otherwise(F.lit(0)).cast("long").alias("serial"))


# What marks paths (with forward slashes) as chat media, program resources, noise or valuable.
CHAT_MEDIA = r"(?i)/(FileRecv|Image|Pic|Video|Ptt|Audio|Voice|cdn/download|nt_data/Video|nt_data/File|MsgAttach)/"
HARD_NOISE = r"(?i)/(avatar|emoji|baseemojisyastems|emoji-recv|emojirecv|emojirelated|thumbtemp|oritemp|cache|cachestorage|code cache|service worker|local storage|session storage|indexeddb|xplugin|xworker|publiclib|offlineresource|dynamicresource|dynamicresourcepackage|upgrade|patch|crash|caton_dump|logs?|log-cache|tbs|tzdata|qzone|webview|cef_|hpModule)/"
APP_RESOURCE = r"(?i)/(resources?|themes?|locales?|compatible_web|raw|shader|shaders|aekit|node_modules|_next/static|static/chunks|wxdrive|wemeet|virtualaudio)/"
NOISE_FILE = r"(?i)\.(dll|exe|pak|bin|dmp|wmc|gft|cur|cat|inf|mmap3|stk|tk|tv|sst|ldb|db|db-shm|db-wal|xlog|qqxlog|log|old|ini|map)$"
PROGRAM_FILE = r"(?i)\.(dll|exe|pak|bin|dmp)$"
VALUABLE = "(^|[^a-z])ai([^a-z]|$)|(^|[^a-z])bp([^a-z]|$)|llm|prompt|openai|claude|创业|商业|项目|方案|课程|学业|作业|考试|复习|基医|强基|医学|生物|化学|物理|高数|英语|思政|专业|科研|论文|实验|比赛|竞赛|森林|树林|笔记|资料|简历|合同|发票|报销|预算|课题|需求|prd|roadmap"
QQ_PROGRAM = r"(?i)/AppData/Roaming/QQ/(arks|blob_storage|cache|code cache|crashpad|dawngraphitecache|dawnwebgpucache|dictionaries|dynamic_module|dynamic_package|gpucache|local storage|miniapp|network|packages|partitions|qqex|session storage|shared dictionary)/"
TENCENT_PROGRAM = r"(?i)/Tencent/(Androws/context_menu|WeMail/cache|WXWork/wwmapp/userdata/Global/Data/AudioModel)/"
PROGRAM_RESOURCE = f"{QQ_PROGRAM}|{TENCENT_PROGRAM[4:]}"


# The kinds of media files, and the sizes in pixels that their variants' names end with.
MEDIA_FILE = r"(?i)\.(png|jpe?g|gif|webp|bmp|mp4|mov|mkv|webm|mp3|wav|ogg|silk|amr)$"
MEDIA_SIZE = r"(?i)_(0|360|480|720|750|1080)$"


def media_variant_key(path: Column) -> Column:
    """The file name that variants of one picture, video or sound share: without its size, .jpeg as .jpg; empty for other files."""
    name = F.element_at(F.split(slashed(path), "/"), -1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    key = F.concat(F.lower(F.regexp_replace(stem, MEDIA_SIZE, "")), F.replace(F.lower(ext), F.lit(".jpeg"), F.lit(".jpg")))
    return F.when(name.rlike(MEDIA_FILE), key).otherwise("")


def safe_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")), F.lit("")), F.lit("unnamed"))


def path_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"))


def append_hash8(path: Column, sha: Column) -> Column:
    ext = F.regexp_extract(path, r"(\.[^./\\]+)$", 1)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(ext)), F.lit("-"), F.substring(sha, 1, 8), ext)


def insight_score(text: Column, rules: Rules = INSIGHT_CATEGORIES, advice: str = ADVICE) -> Column:
    return F.least(F.length(text), F.lit(180)) + F.when(text.rlike(f"(?iu){advice}"), 60).otherwise(0) + F.when(first_match(text, rules, None).isNotNull(), 30).otherwise(0)


def importance(score: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.floor(score / 50 + 0.5))).cast("int")


def cut(c: Column, limit: int) -> Column:
    """At most limit code points, the last one an ellipsis if anything was cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def insight_title(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)https?://\S+", ""), r"\s+", " "))
    phrase = F.element_at(F.filter(F.split(plain, "[，。！？；\n]"), lambda x: x != ""), 1)
    return cut(F.coalesce(F.when(F.size(F.filter(F.split(plain, "[，。！？；\n]"), lambda x: x != "")) > 0, phrase), F.lit("本轮新增记录")), 24)


def distillable(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return (F.length(t) >= 12) & ~t.rlike(r"(?iu)^(?:收到|好的|谢谢|嗯嗯|哈哈|没问题|好滴|OK|okk)[!！。.]?$") & ~t.rlike(r"(?i)^https?://\S+$") & ~t.contains("我通过了你的朋友验证")


def noise_text(c: Column) -> Column:
    """Under 12 characters without white space, hex-like, nothing but empty words, or one character over and over."""
    t = F.regexp_replace(c, r"\s+", "")
    return (F.length(t) < 12) | t.rlike(f"(?i){HEX_LIKE}") | t.rlike(f"(?i){EMPTY_WORDS}") | t.rlike(r"(.)\1{18,}")


def useful_text(c: Column) -> Column:
    """No noise, and written in Han or holding a telling word."""
    return ~noise_text(c) & (c.rlike("[\u4e00-\u9fff]") | c.rlike(f"(?iu){USEFUL}"))
