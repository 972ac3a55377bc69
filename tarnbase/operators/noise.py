"""Which lines of a chat say nothing worth keeping, and of which kind they are.

A kind is a named predicate over the cleaned line. The kinds are looked at in
the order of KINDS, and the first that holds names the line's noise; the
address of a picture is never noise. Questions are never advertising, and a
line that names something of the business is never off topic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbase.functions.text import CHAT_URL, cjk_count, is_image_answer, qa_key, sanitise_chat, text

# What the kinds of noise are told by. Patterns are searched for without regard to case.

#: Acknowledgements.
ACKNOWLEDGEMENTS = (
    "好", "好的", "收到", "已收到", "嗯", "嗯嗯", "ok", "谢谢", "感谢", "辛苦了", "麻烦了", "可以", "可以的", "是的", "对", "对的", "不是", "1", "应该是", "应该可以",
    "看着应该是了", "没问题", "yes", "no", "yep", "nope", "sure", "thanks", "thank you", "thx", "noted", "noted a moment", "one moment", "wait a moment", "sorry", "oh sorry",
)
#: Whole lines of the chat system, as keys.
SYSTEM_LINES = ("群聊信息已更新", "群公告已更新", "群名称已更新")
#: Lines of the chat system and of those who run a group.
SYSTEM = (
    r"^[\[【(（]?\s*(群聊信息|群公告|群名称|群二维码|群信息)\s*已更新\s*[\]】)）]?$",
    r"(通过扫描|邀请).{0,30}(加入群聊|加入了群聊)",
    r"(此群专注|此群是|本群是|群内请|群里请|请所有入群)",
    r"修改群内?备注|修改群被?姓名备注|基础信息问卷|填写.{0,12}问卷|提交问卷|再提问|不要拉人|拉人入群|后续.*邀请|定期清人|改个备注|了解.{0,8}业务|代运营/孵化",
)
#: A welcome to a group, which counts if it also speaks of the group.
WELCOME = r"(欢迎加入|欢迎.*入群|入群卖家|群昵称|群公告|群规则|定期清退|清理不在问卷池|不要随意拉人进群)"
OF_GROUP = r"(群|卖家|问卷|公告|运营资料|昵称|清退|拉人)"
#: Signs of a question, which advertising does not ask.
ASKS = r"[?？]|吗|嘛|么|是否|怎么|为什么|能不能|有没有|什么情况|不显示|找不到|打不开"
#: Phrases of advertising.
PROMOTION = (
    r"扫码.{0,12}报名", r"扫描.{0,12}二维码", r"报名链接", r"用.{0,12}链接.{0,12}优惠", r"提供的链接.{0,12}优惠", r"点击.{0,12}(报名|领取|加入)", r"名额有限", r"席位有限", r"限时福利",
    r"新人福利", r"服务商礼包", r"免费领取", r"闭门私董会", r"招商大会", r"大卖.{0,8}私董会", r"直播.{0,12}报名", r"直播课堂", r"正在开播", r"卖家成长训练营", r"热卖选品指南",
    r"消费趋势数据", r"选品风向标", r"爆单选品运营指南", r"课程.{0,12}报名", r"峰会.{0,12}报名", r"trial bonus",
)
#: Words of advertising, of which three count together with a link or a code.
PROMOTION_WORDS = ("报名", "福利", "优惠", "折扣", "礼包", "私董会", "大会", "峰会", "直播", "课程", "席位", "名额", "扫码", "二维码", "海报", "活动详情", "注册链接", "立即加入", "限时", "免费领取")
LINK_OR_CODE = r"https?://|www\.|二维码|扫码|海报"
#: Lines that only point at what was sent.
POINTING = (
    r"^\s*for your reference\s*$",
    r"^\s*check this\s*$",
    r"^\s*check this to (?:set up|register|create|open).{0,80}(?:acc|account|register|transfer)?.*$",
    r"^\s*sign in by this link and tap\s*\[[^\]]+\]\s*$",
    r"^\s*when you make transfer,?\s*you will need this\.?\s*$",
    r"^\s*and here[’'\"]?s a detailed guide.*take a look.*$",
    r"^.*注册流程.{0,12}参考这里面.*$",
    r"^.*参考这里面.{0,12}(?:详细|每一步).*$",
    r"^\s*来注册\s*$",
    r"^\s*click this,?\s*provide passport.*trial bonus.*$",
)
#: What makes a line one about a link; what a few words beside a link say; where they send one to read.
LINKED = r"https?://|www\.|docs\.qq\.com|kks\.ink"
LINK_WORDS = r"教程|合集|链接|资料|文档|官网|学习|参考|这里|查看|指南|入驻链接"
SENT_TO_READ = r"(请|可以)?.{0,4}(在|去|到)?.{0,8}(官网|文档|链接|教程|资料).{0,8}(学习|查看|参考|查询)"
#: Arrangements about a single case.
COORDINATION = (
    r"帮你申诉|帮你催|我帮你|已反馈|给你处理|我来处理|我看看|我再看看|耐心等待|过段时间再尝试|你的朋友如果注册|后续我们也会邀请|反馈下你的问题|定点帮你看|帮你看下你的店铺|提交申诉|开个case.{0,8}申诉|明天再尝试登录|不是官方的技术原因|服务商资源|添加我微信|加我微信|推荐招商经理|其他卖家都可以.{0,12}再尝试|再尝试下|无法登录的bug|选择客服助手即可|客服助手即可|自己找一下|@我邮箱号码|邮箱号码|订单号发给后台客服|把订单号发给后台客服|发给后台客服咨询|账单\s*id.{0,12}后台客服|费用.{0,20}账单\s*id.{0,20}后台客服|后台客服.{0,12}判断是什么支出|光看这个我看不出来|换浏览器.{0,20}VPN.{0,30}(?:隔天|明天|今天|再试|多尝试)|如果今天无法连接.{0,20}隔天",
    r"send me .*?(phone|email)|register phone number|register email|speed up the process|pay agent|agent .*get code|ask an agent|agent\s*/\s*HR|tax beurea|get the register code|then i can[’'\"]?t do it now|how can we help|i don[’'\"]?t seem to have",
    r"账号要养|分配了个账号|小助手.{0,12}启用|用文字.{0,8}咨询小助手|有问题请@.*客服助手|@[^ \n\r\t\x{2005}]{0,80}(?:客服助手|小助手)|具体截图看看|截图看看|升级知识库|审核功能.{0,20}(?:上线|会上)|当前有过的对话.{0,12}学习|机器网络.{0,12}修复|机器人在群里面|观察到对应的对话|不需要联系技术支持|网络问题.{0,12}刷新|近期.{0,8}bug|bug.{0,12}(?:正在修复|修复中|期间)|目前.{0,8}bug期间|系统.{0,12}升级.{0,20}bug|系统.{0,20}bug.{0,20}(?:改天|再尝试|VPN|修复)|我们已在修复|正在修复|紧急修复|近期恢复正常|改天再尝试|下个星期再尝试|下周再尝试",
    r"\b(noted|one moment|wait a moment|oh[, ]+sorry|sorry[, ]+i misunderstood)\b",
)
#: Words of the business, besides the names of its own platforms (NoiseRules.brands).
DOMAIN = r"KYC|RFC|SKU|FBM|FULL|店铺|账号|入驻|注册|审核|上传|物流|收款|绑定|广告|发货|揽收|订单|类目|刊登|上架|商品|资料|护照|签证|税|银行|流水|平台|后台"
#: Words that have nothing to do with it, and pleasantries of a short line.
OFF_TOPIC = r"手抓饼|芝士|烤箱|离焦镜|三年级|录播|作业|热镀锌|群里姐妹|项目部|提前入园|弄个提前|供货还是运输"
PLEASANTRIES = r"太晚了|哈哈|捂脸|抱拳|辛苦|感谢|谢谢|收到"
#: Signs that a call by name goes on to ask or to answer.
CALL_ASKS = r"[?？吗呢]|怎么|有没有|什么|是否|可以|能不能|能否|麻烦|帮忙"
CALL_ANSWERS = r"是|不是|需要|无需|可以|不能|建议|填写|提供|提交|属于|指|适合|必须|先|然后|如果|即可"
#: A call by name; a picture in a text or in its place.
MENTION = r"@[^ \n\r\t\x{2005}]+"
PICTURE = r"<img\b|!\[[^\]]*\]\([^)]+\)|^[\[【(（]?\s*(图片|image|img|photo|picture)\s*\d*\s*[\]】)）]?$"


@dataclass(frozen=True)
class NoiseRules:
    """What is particular to a line of business: patterns of its platforms' names (which make a line one about the business), and of further arrangements about cases."""

    brands: tuple[str, ...] = ()
    arrangements: tuple[str, ...] = ()


def _says(t: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike("(?i)" + p)
    return out


def _without(t: Column, *patterns: str) -> Column:
    for p in patterns:
        t = F.regexp_replace(t, p, "")
    return t


def _system(t: Column, rules: NoiseRules) -> Column:
    return qa_key(t).isin(*SYSTEM_LINES) | _says(t, *SYSTEM) | (_says(t, WELCOME) & _says(t, OF_GROUP))


def _promotion(t: Column, rules: NoiseRules) -> Column:
    words = sum((t.contains(w).cast("int") for w in PROMOTION_WORDS), F.lit(0))
    return ~_says(t, ASKS) & (_says(t, *PROMOTION) | ((words >= 3) & _says(t, LINK_OR_CODE)))


def _link(t: Column, rules: NoiseRules) -> Column:
    rest = _without(t, CHAT_URL, MENTION)
    n = F.length(qa_key(rest))
    return _says(t, *POINTING) | (_says(t, LINKED) & ((n == 0) | ((n <= 12) & _says(rest, LINK_WORDS)) | _says(rest, SENT_TO_READ)))


def _coordination(t: Column, rules: NoiseRules) -> Column:
    return _says(t, *COORDINATION, *rules.arrangements)


def _off_topic(t: Column, rules: NoiseRules) -> Column:
    return ~_says(t, DOMAIN, *rules.brands) & (_says(t, OFF_TOPIC) | ((F.length(qa_key(t)) <= 12) & _says(t, PLEASANTRIES)))


def _acknowledgement(t: Column, rules: NoiseRules) -> Column:
    keys = sorted({w.replace(" ", "") for w in ACKNOWLEDGEMENTS} | {""})
    return qa_key(_without(t, r"[\[【(（][^\]】)）]{1,12}[\]】)）]")).isin(*keys)


def _garbled(t: Column, rules: NoiseRules) -> Column:
    return F.regexp_count(t, F.lit("�")) > 0.03 * F.greatest(F.length(t), F.lit(1))


def _call(t: Column, rules: NoiseRules) -> Column:
    after = F.trim(F.regexp_replace(t, f"(?s)^(.*?){MENTION}", "$1"))
    return t.startswith("@") & (F.length(after) <= 20) & ~_says(t, CALL_ASKS) & ~_says(after, CALL_ANSWERS)


def _empty(t: Column, rules: NoiseRules) -> Column:
    return F.length(qa_key(_without(t, CHAT_URL, MENTION))) <= 1


def _blob(t: Column, rules: NoiseRules) -> Column:
    return (F.length(t) >= 80) & (cjk_count(t) == 0) & t.rlike(r"[A-Za-z0-9+/=_-]{80,}")


#: The kinds, in their order.
KINDS: dict[str, Callable[[Column, NoiseRules], Column]] = {
    "system": _system, "promotion": _promotion, "link": _link, "coordination": _coordination, "off_topic": _off_topic, "acknowledgement": _acknowledgement,
    "garbled": _garbled, "call": _call, "empty": _empty, "blob": _blob,
}
#: Kinds whose pictures go with them.
OF_BUSINESS = ("system", "promotion", "link", "coordination", "off_topic", "acknowledgement")


def is_kind(kind: str, content: Column | str, rules: NoiseRules = NoiseRules(), clean: bool = False) -> Column:
    """Whether a line is noise of one kind. clean: the line has been sanitised before."""
    t = text(content) if clean else sanitise_chat(content)
    return KINDS[kind](t, rules)


def noise_kind(content: Column | str, rules: NoiseRules = NoiseRules(), keep_images: bool = True, clean: bool = False) -> Column:
    """The kind of noise of a line, "blank" and "markup" included; null if it says something."""
    t = text(content) if clean else sanitise_chat(content)
    low = F.lower(t)
    out = F.when(t == "", "blank").when(low.startswith("<sysmsg") | low.startswith("<msg") | low.startswith("<?xml") | low.contains("<![cdata["), "markup")
    if keep_images:
        out = out.when(is_image_answer(t) | _says(t, PICTURE), F.lit(None).cast("string"))
    for name, holds in KINDS.items():
        out = out.when(holds(t, rules), name)
    return out


def is_noise(content: Column | str, rules: NoiseRules = NoiseRules(), keep_images: bool = True, clean: bool = False) -> Column:
    return noise_kind(content, rules, keep_images, clean).isNotNull()


def mark_noise(df: DataFrame, content: str, name: str = "noise", rules: NoiseRules = NoiseRules(), keep_images: bool = True, kind: str | None = None) -> DataFrame:
    """df with whether each line is noise and, if `kind` names a column, of which kind. The cleaned line and the kind are columns of their own, so they are worked out once."""
    t = df.withColumn("__clean", sanitise_chat(content)).withColumn("__kind", noise_kind("__clean", rules, keep_images, clean=True))
    t = t.withColumn(name, F.col("__kind").isNotNull())
    return (t.withColumn(kind, F.col("__kind")) if kind else t).drop("__clean", "__kind")


def keep_image_of_noise(content: Column | str, rules: NoiseRules = NoiseRules(), clean: bool = False) -> Column:
    """Whether the picture of a mixed message stays although its text is noise: if the text is blank, unreadable or empty, not if it is noise of business."""
    t = text(content) if clean else sanitise_chat(content)
    business = F.lit(False)
    for k in OF_BUSINESS:
        business = business | KINDS[k](t, rules)
    return F.when(t == "", True).when(business, False).otherwise(_garbled(t, rules) | _empty(t, rules))
