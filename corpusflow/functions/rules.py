"""Word lists and patterns of the classifiers, as data."""

from __future__ import annotations

from typing import NamedTuple

#: Words that walls, banners and forms are made of; each counts once.
BOILERPLATE = sorted("""
    sign·in|cookie|copyright|login|password|privacy|register|密码|条款|注册|登录|登录后查看|立即登录|请先登录|请登录后|隐私|需要登录|验证|验证码
""".strip().replace("·", " ").split("|"))
SKELETON = ["加载中", "正在加载", "请稍候"]


def _optional(words: str) -> list[str]:
    return [f"/{w}[/?#]?" for w in words.split()]


def _files(*groups: str) -> list[str]:
    return [rf"\.({'|'.join(g.split())})(\?|$)" for g in groups]


#: In order; the first that is found names the reason.
NOISE_HIGH = [
    *_optional("login signup register logout auth oauth"),
    *_optional("search find"), *[rf"\?{w}=" for w in "s q search keyword query".split()], "/s/", "/search/",
    *_optional("admin"), "/wp-admin", *_optional("dashboard settings account profile"),
    *_optional("cart checkout payment order billing"),
    *_files("png jpg jpeg gif svg webp ico", "css js json xml rss atom", "pdf doc docx xls xlsx ppt pptx zip tar gz", "mp4 mp3 avi mov wmv flv webm"),
    *[f"^{w}:" for w in "mailto tel javascript".split()], "^#$", "^#.*",
]
NOISE_MID = [
    *[f"/{w}/" for w in "tag(s)? category categories archives? author user".split()],
    *["/" + r"\d{4}/" + r"\d{2}/" * k + "$" for k in (1, 2)],
    *[f"/{w}" for w in "comment trackback pingback".split()],
    *_optional("share embed"), r"\?print=", *_optional("print amp"), *[rf"{w}[2-9]\d*" for w in ("/page/", r"\?paged?=")],
    *_optional("feed rss atom privacy terms tos legal disclaimer about contact help faq support"),
]
UNLIKELY = [r"/search[/?]", *[f"/{w}" for w in "login signup register tag/ category/ author/ about contact privacy terms".split()], rf"\.({'|'.join('png jpg gif svg css js'.split())})$"]

#: (type, parts of an address) in order.
ADDRESSES = [
    ("novel", "69shu 17k biqu biquge book chapter du1du novel paoshu8 qidian qiego read shuqi xbiquge xiaoshuo zongheng".split()),
    ("blog_article", "blog cnblogs dev.to hashnode jianshu juejin medium segmentfault weixin zhihu".split()),
    ("documentation", "doc guide manual readthedocs reference tutorial wiki".split()),
    ("job", "51job glassdoor indeed job lagou liepin zhaopin zhipin".split()),
    ("news", "163.com 36kr geekbang huxiu ifeng news sina sohu thepaper toutiao".split()),
]

_N = "一二三四五六七八九十百千"


class Signature(NamedTuple):
    kind: str
    least: int
    must: list[tuple[str, int]]
    others: list[tuple[str, int]]


_CHAPTER = rf"第[{_N}\d]+章"
_DAY = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"
#: In order of precedence at equal scores; every pattern counts once.
SIGNATURES = [
    Signature("novel_chapter", 500, [(_CHAPTER, 10), (_CHAPTER[:-1] + "[节回卷]", 8), ("(章|节)" + r"[\s\n]", 5)],
              [("[。！？…\n]{3,}", 15), ("喊道|心道|想到|暗想|说道", 8), ("只见|当下|忽然|接着|随后|顿时", 5), ("[一-鿿]{100,}", 3),
               ("代码|函数|安装|部署|配置|import|npm|pip", -15), ("学历|岗位|招聘|经验|薪资", -15)]),
    Signature("novel_index", 200, [(_CHAPTER, 5)], [("作品相关|分卷|正文卷|章节目录", 10), ("加入书架|开始阅读|最新章节|最近更新", 8), ("作者[:：]", 5), ("[。！？…\n]{5,}", -10)]),
    Signature("blog_article", 300, [(f"发布于|发表于|{_DAY}", 5)], [("关注|分享到|打赏|收藏|点赞", 8), ("作者|原创|版权|转载", 6)]),
    Signature("documentation", 200, [("|".join(["```", "`[^`]+`"]), 5)], [("使用|参数|安装|注意|示例|警告|返回|配置", 8), ("class|export|function|import|npm|pip|require", 10)]),
    Signature("job", 100, [("工资|待遇|薪资|薪酬", 10)], [("JD|岗位|招聘|职位", 8), ("学历|福利|经验|职责|要求", 6), ("Boss|HR|内推|猎头", 4)]),
    Signature("news", 200, [(rf"\d{{4}}年\d{{1,2}}月\d{{1,2}}日|{_DAY}", 8)], [("据悉|报道|消息|目前|记者|近日", 6), ("责任编辑|(来源|编辑)[:：]", 5)]),
]

#: (kind, [(pattern, whether group 1 is the site's key)]) in order.
_KEYS = [(f"data-sitekey={q}([^{q}]+){q}", True) for q in ('"', "'")]
CAPTCHAS = [
    ("recaptcha_v2", [(p, False) for p in ('g-recaptcha"', r"google\.com/recaptcha", r"recaptcha/api\.js")] + _KEYS),
    ("hcaptcha", [('h-captcha"', False), (r"hcaptcha\.com/1/api\.js", False), _KEYS[0]]),
    ("cloudflare_turnstile", [(p, False) for p in (r"challenges\.cloudflare\.com", "cf-turnstile", r"turnstile/v0/api\.js")]),
    ("cloudflare_challenge", [(p, False) for p in ("Checking your browser", "cf-browser-verification", "_cf_chl_opt")]),
    ("generic_captcha", [(p, False) for p in ("请输入验证码", "请完成验证", "人机验证", r"verify[\s_-]?(you|human|bot)", r"are you a (human|robot)", "captcha")]),
]

#: (pattern, ignoring case): what the text of a link to a chapter looks like.
CHAPTER_LINKS = [*[(rf"第\s*\d+\s*{w}", False) for w in "章节回"], *[(rf"{w}[\.\s]*\d+", True) for w in ("Ch(apter)?", "Ep(isode)?", "Part")], *[(r"^\d+" + end, False) for end in ("$", r"[\.\-\s].+")]]

CODE_MARKS = "=>|=== |constructor(|export |function(|import {|require(|super(|typeof".split("|")
STREAMING_HOSTS = r"dingtalk|docs\.qq|feishu|kdocs|shimo|wps"
TAIL_WORDS = "下载|书签|分享|加入书架|举报|安装|手机版|打赏|推荐|收藏|电脑版"
NUMERALS = {c: k for k, c in enumerate("零一二三四五六七八九")}
UNITS = {"十": 10, "百": 100, "千": 1000}



def _codes(text: str) -> dict[str, str]:
    return dict(zip(text.split()[::2], text.split()[1::2]))


#: platform: (address with {keyword}, {city}, {city_code} and {page}, pattern of a detail address, codes of cities)
PLATFORMS = {
    "51job": ("https://we.51job.com/pc/search?keyword={keyword}&area={city_code}&page={page}", r"51job\.com/\w+/\d+\.html", _codes("北京 010000 深圳 040000 长沙 180200")),
    "boss": ("https://www.zhipin.com/web/geek/job?query={keyword}&city={city_code}&page={page}", r"zhipin\.com/job_detail/[a-f0-9]+\.html",
             _codes("上海 101020100 北京 101010100 南京 101190100 广州 101280100 成都 101270100 杭州 101210100 武汉 101200100 深圳 101280600 长沙 100010000")),
    "lagou": ("https://www.lagou.com/wn/jobs?kd={keyword}&city={city}&pn={page}", r"lagou\.com/jobs/\d+\.html", {c: c for c in ("上海", "北京", "广州", "杭州", "深圳", "长沙")}),
    "liepin": ("https://www.liepin.com/zhaopin/?key={keyword}&dqs={city_code}&curPage={page}", r"liepin\.com/job/\d+\.s?html", _codes("上海 020000 北京 010000 广州 050020 杭州 080020 深圳 050090 长沙 070200")),
    "maimai": ("https://maimai.cn/web/jobs?query={keyword}&city={city}&page={page}", r"maimai\.cn/web/jobs\?", {}),
    "zhaopin": ("https://sou.zhaopin.com/?kw={keyword}&city={city_code}&p={page}", r"zhaopin\.com/jobdetail/[A-Z0-9]+\.html", _codes("上海 538 北京 530 深圳 765 长沙 730")),
}
#: where a platform's relative addresses belong
PLATFORM_SITES = {"51job": "https://we.51job.com", "boss": "https://www.zhipin.com", "lagou": "https://www.lagou.com", "liepin": "https://www.liepin.com", "maimai": "https://maimai.cn", "zhaopin": "https://sou.zhaopin.com"}
