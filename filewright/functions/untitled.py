"""Whether a file name says what is in the file: untitled, generic or named, with a reason.

Untitled names are those that systems, cameras, browsers and messengers give, recognised whole; a
generic name is made of general words and versions alone. All of it is Columns, but for the
composition of names that are not ASCII. Whether a run without blanks is made of general words is a
fold over its positions: a position is reached if a word of the dictionary ends there that begins at
a reached one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright.functions.text import nfkc

# --- Fixed values: lengths, extensions, marks of copies, names that programs give, general words ---
MOST_CHARS, MOST_GENERIC, MOST_TOKENS = 131_072, 256, 8
TEMP_PREFIXES, TEMP_NAMES = ("~$", ".~lock.", "._"), (".ds_store", "thumbs.db", "ehthumbs.db", "desktop.ini")
KNOWN_EXT = (
    "pdf doc docx docm dot dotx xls xlsx xlsm xlsb xltx ppt pptx pptm pps ppsx potx odt ods odp odg rtf txt md csv tsv "
    "key pages numbers epub mobi azw3 djvu xps oxps hwp wps one vsdx tex bib html htm mht mhtml json xml yaml yml log "
    "jpg jpeg jfif png gif heic heif webp avif bmp tif tiff svg ico psd ai eps xcf kra sketch fig xd drawio excalidraw xmind "
    "arw cr2 cr3 nef dng raf orf rw2 aae mp4 mov m4v avi mkv webm wmv flv 3gp mts m2ts mp3 m4a wav aac flac ogg opus wma amr srt vtt "
    "zip rar 7z tar gz tgz bz2 xz zst dmg pkg iso exe msi apk ipa deb rpm jar "
    "ipynb py js mjs ts c cpp h java go rs rb php sh bat ps1 r swift kt sql css "
    "crdownload part partial download tmp temp bak ics vcf eml msg torrent lnk url webloc"
).split()
WRAPPER_EXT = "crdownload part partial download tmp temp bak gz bz2 xz zst".split()
WORD_EXT = "ai bat bib deb dot download fig go java key log numbers one opus pages part partial sketch swift temp tex torrent".split()
COPY_WORDS, COPY_PREFIX = "copy|副本|的副本|複製|拷貝|复制|拷贝|コピー", "copy of "
TIME_CHARS, TIME_WORDS = r"[0-9 ._:,\-]", "at(?![a-z])|am(?![a-z])|pm(?![a-z])|上午|下午|中午|晚上|凌晨|早上|於"
MONTHS = "|".join(f"{m}(?![a-z])" for m in "jan feb mar apr may jun jul aug sep oct nov dec".split())
UNTITLED = (
    r"^(?:(?:untitled|未命名|無標題|无标题)(?: ?(?:document|spreadsheet|presentation|design|diagram|drawing|form|file|folder|project|notebook|文件|文字文件|檔案|試算表|簡報|設計|表單|資料夾|文件夹|筆記本|文檔|文档|表格|演示文稿|繪圖|绘图))?"
    r"|unsaved document|未儲存文件)(?:[ _-]?[0-9]{1,4}| [0-9a-f]{32})?$|^無題 [0-9]{1,4}$"
)
WINDOWS_NEW, WINDOWS_NEW_CHARS = (
    "新增文字文件", "新增microsoftword文件", "新增microsoftexcel工作表", "新增microsoftpowerpoint簡報", "新增microsoftaccess資料庫", "新增點陣圖影像",
    "新增rtf文件", "新增資料夾", "新增壓縮的(zipped)資料夾", "newtextdocument", "newmicrosoftworddocument", "newmicrosoftexcelworksheet",
    "newmicrosoftpowerpointpresentation", "newmicrosoftaccessdatabase", "newbitmapimage", "newrichtextdocument", "newfolder",
    "newcompressed(zipped)folder", "新建文本文档", "新建microsoftword文档", "新建microsoftexcel工作表", "新建microsoftpowerpoint演示文稿",
    "新建位图图像", "新建文件夹",
), 64
OFFICE = r"^(?:(?:document|文件|文档)[0-9]{0,4}|(?:book|presentation|publication|drawing|database|活頁簿|簡報|工作簿|演示文稿)[0-9]{1,4})$"
SCREENSHOTS = "screenshot|screen shot|screen recording|螢幕擷取畫面|螢幕截圖|螢幕快照|螢幕錄影|螢幕錄製|截圖|截图|截屏|屏幕截图|屏幕快照|屏幕录制|录屏|スクリーンショット|capture|snipaste"
GNOME = r"^(?:(?:screenshot|screencast) from( [0-9 ._:-]*(?:[ap]m)?)|([0-9 ._:-]+)的?(?:螢幕擷圖|屏幕截图)(?: - [0-9]{1,3})?)$"
ANDROID = r"^screenshot_(?:[0-9]{8}[-_][0-9]{6}|[0-9]{4}(?:-[0-9]{2}){5}(?:-[0-9]{1,3})?)_(.+)$"
APP_LABELS = (
    "chrome", "samsung internet", "firefox", "edge", "line", "instagram", "facebook", "messenger", "whatsapp", "telegram", "discord", "wechat",
    "kakaotalk", "youtube", "tiktok", "threads", "twitter", "x", "reddit", "snapchat", "pinterest", "linkedin", "gmail", "outlook", "google",
    "maps", "google maps", "photos", "google photos", "gallery", "camera", "settings", "one ui home", "messages", "phone", "contacts", "calendar",
    "clock", "my files", "drive", "classroom", "teams", "zoom", "slack", "spotify", "netflix", "dcard", "shopee",
)
PACKAGES = (
    "com.whatsapp", "com.discord", "com.pinterest", "com.tinder", "com.duolingo", "jp.naver.line.android", "org.telegram.messenger",
    "org.mozilla.firefox", "org.thoughtcrime.securesms", "org.wikipedia", "org.videolan.vlc", "tv.twitch.android.app", "tv.danmaku.bili",
    "us.zoom.videomeetings", "cn.wps.moffice_eng",
)
COM_PACKAGE = r"^com(?:\.[a-z][a-z0-9]{0,39}){2,7}$"
RESERVED = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null"
).split()
SCANS = "scanned document|scanned image|scanned|scan|掃描文件|掃描檔|掃描|扫描件|扫描|camscanner"
MESSENGERS = r"whatsapp (?:image|video|audio|ptt|document|sticker)(?![a-z])|photo_|video_|signal-|telegram "
MESSENGER = r"^(?:(?:img|vid|aud|ptt|doc|stk)-[0-9]{8}-wa[0-9]{3,}|fb_img_[0-9]{10,}|received_[0-9]{8,}|mmexport[0-9]{10,}|微信(?:图片|圖片)_[0-9]{8,}(?:_[0-9]{1,6})?)$"
LINE = r"^(?:messageimage_[0-9]{6,}|line_album_[0-9 ._-]*|line_(?:p|movie|video|voice)?_?[0-9]{6}[0-9_]*|s__[0-9]{6,}(?:_[0-9]{1,3})?)$"
CAMERA_TAIL = "(?:mp|hdr|portrait|night|bokeh|cover|original|edited|raw-[0-9]{2}|burst[0-9]{0,4}|[0-9]{1,4})"
CAMERA = (
    rf"^(?:(?:img|vid|pxl|pano|mvimg|burst)[_-][0-9]{{8}}[_-][0-9]{{6,9}}(?:[_-][0-9]{{1,20}}){{0,2}}(?:[._~-]{CAMERA_TAIL}){{0,3}}"
    r"|(?:img|vid|pxl|pano|mvimg|burst|mov)[_-]e?[0-9]{3,}(?:[_-][0-9]{1,20}){0,3}(?:[._~-][0-9]{1,4}|-edited)?"
    r"|_?dsc[nf]?_?[0-9]{3,}|_mg_[0-9]{4,}|(?:imgp|cimg|pict|hpim|sam_|dji_)[0-9]{3,}(?:_[0-9]{1,20}){0,3}"
    r"|p[0-9]{7}|gopr[0-9]{4}|g[hxp][0-9]{6})(?: [0-9]{1,3})?$"
)
RECORDING = r"^(?:(?:new recording|新錄音|新录音)(?: [0-9]{1,4})?|gmt[0-9]{8}-[0-9]{6}(?:_recording(?:_(?:gallery|avo|as|cc))?(?:_[0-9]{3,4}x[0-9]{3,4})?)?)$"
BROWSER = r"^(?:download|下載|下载|file|image|images|unnamed|blob|attachment)[0-9]{0,4}$"
UUID, HEX, DIGITS = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[0-9a-f]{16,}$", r"^(?=.*[0-9])[0-9 ._:,+()#~-]+$"
GENERIC_WORDS = (
    "report reports final draft drafts note notes test tests lecture lectures hw homework assignment assignments slide slides handout handouts summary "
    "essay paper exam quiz resume cv memo doc docs document file image untitled new old latest revised updated edited fixed copy sample example template "
    "temp tmp misc stuff work project presentation book data info photo photos picture pic version ver backup bak todo list form answer answers solution "
    "solutions exercise review outline my "
    "報告 筆記 講義 作業 草稿 考試 小考 測驗 測試 最終版 最終 終版 定稿 修正版 修改版 新版 舊版 最新 最新版 完整版 初稿 簡報 活頁簿 資料 檔案 文件 圖片 照片 相片 心得 範本 範例 備份 副本 "
    "複製 拷貝 表單 清單 履歷 自傳 投影片 作品 企劃書 計畫書 報告書 說明 筆記本 講稿 解答 答案 習題 練習 重點 整理 未命名 我的 新 舊 报告 笔记 讲义 作业 最终版 资料 文档 图片 unknown 無題"
).split()
ZH_VERSION = r"第[0-9一二三四五六七八九十]{1,3}版|版本[0-9]{1,4}"
VERSION = r"^(?:(?:v|ver|version|rev)\.?[0-9]{1,4}(?:\.[0-9]{1,4}){0,3}[a-z]?|第?[0-9一二三四五六七八九十]{1,3}版|版本[0-9]{1,4})$"
TOKEN = r"[^ _\-,+&()\[\]{}]+"
PICTOGRAPHS = (
    r"[\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}-\x{21aa}\x{231a}-\x{231b}\x{2328}\x{2388}\x{23cf}\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}"
    r"\x{24c2}\x{25aa}-\x{25ab}\x{25b6}\x{25c0}\x{25fb}-\x{25fe}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}"
    r"\x{2716}\x{271d}\x{2721}\x{2728}\x{2733}-\x{2734}\x{2744}\x{2747}\x{274c}\x{274e}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27a1}\x{27b0}"
    r"\x{27bf}\x{2934}-\x{2935}\x{2b05}-\x{2b07}\x{2b1b}-\x{2b1c}\x{2b50}\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}\x{1f000}-\x{1f0ff}\x{1f10d}-\x{1f10f}\x{1f12f}"
    r"\x{1f16c}-\x{1f171}\x{1f17e}-\x{1f17f}\x{1f18e}\x{1f191}-\x{1f19a}\x{1f1ad}-\x{1f1e5}\x{1f201}-\x{1f20f}\x{1f21a}\x{1f22f}\x{1f232}-\x{1f23a}\x{1f23c}-\x{1f23f}"
    r"\x{1f249}-\x{1f3fa}\x{1f400}-\x{1f53d}\x{1f546}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f774}-\x{1f77f}\x{1f7d5}-\x{1f7ff}\x{1f80c}-\x{1f80f}\x{1f848}-\x{1f84f}"
    r"\x{1f85a}-\x{1f85f}\x{1f888}-\x{1f88f}\x{1f8ae}-\x{1f8ff}\x{1f90c}-\x{1f93a}\x{1f93c}-\x{1f945}\x{1f947}-\x{1faff}\x{1fc00}-\x{1fffd}]"
)
# --- End of the fixed values ---

_EXTENSION = r"(?s)^(.*)\.((?=[a-z0-9]*[a-z])[a-z0-9]{1,10})$"
_COPY = rf"(?: ?\([0-9]+\)|(?: - |[ _-])(?:{COPY_WORDS})(?: [0-9]+)?)"
_TIME = rf"{TIME_CHARS}*(?:(?:{TIME_WORDS}){TIME_CHARS}*)*"
_TIME_OR_MONTH = rf"{TIME_CHARS}*(?:(?:{TIME_WORDS}|{MONTHS}){TIME_CHARS}*)*"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prepared(name: Column) -> Column:
    """The last part of a path, composed, white space as single blanks, nothing invisible, lower, trimmed."""
    base = nfkc(F.regexp_replace(name, r"(?s)^.*[/\\]", ""))
    blanks = F.regexp_replace(base, r"[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]", " ")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(blanks, r"[\p{Cc}\p{Cf}]", ""), " {2,}", " ")))


def is_temporary(name: Column) -> Column:
    """Whether a name is that of a lock or system file, which no one is to rename."""
    return _temporary(prepared(name))


def _temporary(low: Column) -> Column:
    return low.isin(*TEMP_NAMES) | reduce(or_, (low.startswith(x) for x in TEMP_PREFIXES))


def _trust(extension: Column) -> Column:
    return F.when(extension.isin(*WORD_EXT), "word").when(extension.isin(*KNOWN_EXT), "sure").otherwise("unknown")


def split_ext(name: Column) -> tuple[Column, Column]:
    """The stem of a prepared name, and how sure it is that what was cut off is an extension: sure, word or unknown.

    A second extension is cut off where the outer one is that of a download, a backup or a packed file.
    """
    outer, stem = F.regexp_extract(name, _EXTENSION, 2), F.regexp_extract(name, _EXTENSION, 1)
    inner, inside = F.regexp_extract(stem, _EXTENSION, 2), F.regexp_extract(stem, _EXTENSION, 1)
    whole = (outer == "") | ((stem == "") & (_trust(outer) == "unknown"))
    twice = (stem != "") & outer.isin(*WRAPPER_EXT) & (inner != "") & (_trust(inner) != "unknown")
    return F.when(whole, name).when(twice, inside).otherwise(stem), F.when(whole, "sure").when(twice, _trust(inner)).otherwise(_trust(outer))


def without_copy_marks(stem: Column) -> Column:
    """The stem without all marks of copies at its end and beginning; something always stays."""
    kept = F.regexp_extract(stem, rf"(?s)^([ _-]*[^ _-].*?){_COPY}*$", 1)
    return F.regexp_replace(F.when(kept != "", kept).otherwise(stem), rf"(?s)^(?:{COPY_PREFIX})+(?=.)", "")


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _dated(core: Column, prefixes: str, rest: str, tail: str = "", need: int | None = None) -> Column:
    """Whether nothing but a time follows one of the prefixes: of ``need`` digits, or of four if it holds words."""
    pattern = rf"^(?:{prefixes})({rest}){tail}$"
    after = F.regexp_extract(core, pattern, 1)
    return core.rlike(pattern) & (_digits(after) >= need if need else ~after.rlike("[^0-9 ._:,-]") | (_digits(after) >= 4))


def untitled_reason(core: Column) -> Column:
    """Why a stem is a name that a program gives, by the first rule that holds; null if none does."""
    app = F.regexp_extract(core, ANDROID, 1)
    package = app.rlike(COM_PACKAGE) & ~F.arrays_overlap(F.split(app, r"\."), F.lit(RESERVED))
    android = core.rlike(ANDROID) & (app.isin(*APP_LABELS, *PACKAGES) | package)
    gnome = core.rlike(GNOME) & (_digits(F.concat(F.regexp_extract(core, GNOME, 1), F.regexp_extract(core, GNOME, 2))) >= 8)
    letters = "(?![a-z])"
    rules = [
        ("untitled word", core.rlike(UNTITLED)),
        ("windows new", (F.length(core) <= WINDOWS_NEW_CHARS) & F.replace(core, F.lit(" "), F.lit("")).isin(*WINDOWS_NEW)),
        ("office", core.rlike(OFFICE)),
        ("screenshot", android | _dated(core, f"(?:{SCREENSHOTS}){letters}", _TIME) | gnome),
        ("scan", _dated(core, f"(?:{SCANS}){letters}", _TIME) | _dated(core, f"adobe scan{letters}", _TIME_OR_MONTH)),
        ("messenger", _dated(core, MESSENGERS, _TIME, "(?:_[0-9a-f]{8})?", 8) | core.rlike(MESSENGER)),
        ("line", core.rlike(LINE)),
        ("camera", core.rlike(CAMERA)),
        ("recording", core.rlike(RECORDING)),
        ("browser", core.rlike(BROWSER)),
        ("uuid", core.rlike(UUID)),
        ("digits", core.rlike(DIGITS)),
        ("hash", core.rlike(HEX)),
    ]
    return F.coalesce(*(F.when(holds, reason) for reason, holds in rules))


def is_word_run(run: Column, words: list[str] | None = None) -> Column:
    """Whether a run is made of words of the dictionary and versions, one after the other."""
    by_length: dict[int, list[str]] = {}
    for word in words or GENERIC_WORDS:
        by_length.setdefault(len(word), []).append(word)

    def step(reached: Column, at: Column) -> Column:
        version = F.regexp_extract(F.substr(run, at + 1), f"^(?:{ZH_VERSION})", 0)
        ends = [F.when(F.substr(run, at + 1, F.lit(n)).isin(*some), at + n) for n, some in sorted(by_length.items())]
        found = F.array_compact(F.array(*ends, F.when(version != "", at + F.length(version))))
        return F.when(F.array_contains(reached, at), F.array_union(reached, found)).otherwise(reached)

    positions = F.sequence(F.lit(0), F.length(run) - 1)
    return F.aggregate(positions, F.array(F.lit(0)), step, lambda reached: F.array_contains(reached, F.length(run)))


def is_generic(core: Column) -> Column:
    """Whether every part of a stem is a run of general words or a version."""
    tokens = F.regexp_extract_all(core, F.lit(f"({TOKEN})"), F.lit(1))
    parts = F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(VERSION), F.array(t)).otherwise(F.filter(F.split(t, r"\."), lambda x: x != ""))))
    few = F.size(parts).between(1, MOST_TOKENS) & (F.length(core) <= MOST_GENERIC)
    return F.when(few, F.forall(parts, lambda p: p.rlike(VERSION) | is_word_run(p))).otherwise(F.lit(False))


def _class(state: str, reason: Column | str) -> Column:
    return F.struct(F.lit(state).alias("state"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _stem_class(stem: Column) -> Column:
    def told(core: Column, why: Column) -> Column:
        symbols = core.rlike(r"^[^\p{L}\p{N}]+$")
        return (
            F.when(stem == "", _class("untitled", "empty")).when(symbols & core.rlike(PICTOGRAPHS), _class("generic", "emoji")).when(symbols, _class("untitled", "symbols"))
            .when(why.isNotNull(), _class("untitled", why)).when(is_generic(core), _class("generic", "general words")).otherwise(_class("named", "named"))
        )

    return _let(without_copy_marks(stem), lambda core: _let(untitled_reason(core), lambda why: told(core, why)))


def name_class(name: Column) -> Column:
    """struct(state, reason) of a file name or path; null for null.

    state is untitled, generic or named. An untitled stem whose extension may be a word of the user's
    is generic, and one whose extension is unknown is judged with it. Temporary files are named: no one
    is to rename them. A name of more than 131,072 characters is generic.
    """

    def judged(low: Column, trust: Column, first: Column) -> Column:
        unsure = (first["state"] == "untitled") & (trust != "sure")
        return F.when(_temporary(low), _class("named", "temporary")).when(unsure & (trust == "word"), _class("generic", "extension is a word")).when(unsure, _stem_class(low)).otherwise(first)

    def of(low: Column) -> Column:
        stem, trust = split_ext(low)
        cut = F.struct(F.trim(stem).alias("stem"), trust.alias("trust"))
        return _let(cut, lambda c: _let(_stem_class(c["stem"]), lambda first: judged(low, c["trust"], first)))

    told = _let(prepared(F.when(F.length(name) <= MOST_CHARS, name)), of)
    return F.when(name.isNull(), F.lit(None)).when(F.length(name) > MOST_CHARS, _class("generic", "too long")).otherwise(told)
