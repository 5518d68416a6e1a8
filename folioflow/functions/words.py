"""Word lists and patterns of the Chinese profile. All of this module is fixed values that results
depend on; patterns are given in the syntax common to Java and RE2."""

STOP_WORDS = (
    "的 了 是 在 有 和 与 就 都 而 及 或 着 过 也 还 又 但 却 让 被 把 从 到 对 给 向 以 为 之 其中 这 那 一下 一些 自己 没有 "
    "这些 那些 这个 那个 一个 某个 里面 上面 下面 时候 什么 哪些 怎么 为什么 吗 呢 啊 吧 可以 可能 应该 会不会 是不是 有没有 "
    "多少 怎样 如何 为何 何时 哪里 哪个 以及 还有 然后 讲讲 详细 介绍"
).split()

HEADING = (
    "^(?:正文\\s*)?(?:第[0-9零〇一二三四五六七八九十百千万两]{1,12}[章节卷回部篇集](?:[\\s：:、.．\\-—]+.{0,48}|.{0,32})"
    "|序章|楔子|引子|前言|后记|尾声|终章|大结局|番外(?:篇)?(?:[\\s：:、.．\\-—]+.{0,40})?)$"
)
SENTENCE_END = "[。！？；]$"

ENDING_MARKERS = ("全书完", "（大结局）", "(大结局)", "大结局", "全文完", "尾声")
TAIL_WORDS = ("结局", "结尾", "最后", "最终", "收尾", "大结局", "结束")
HEAD_WORDS = ("开头", "开篇", "最初", "一开始", "起初", "开始时")
GLOBAL_SIGNALS = ("全书", "整本", "整体", "主题", "主旨", "贯穿", "成长", "变化", "发展", "人物弧光", "比较", "对比", "异同", "共同点", "不同点")
CATALOGUE = "一共有|共有|总共有|多少部|几部|多少本|几本|有哪些小说|哪些书|所有小说|全部小说|书架"
EXHAUSTIVE = "全部|所有|完整|一共|总共|共有|有哪些|多少|几部|几本|列出"

EXPLICIT_FREE = ("不要搜索", "不用搜索", "无需搜索", "不要查原文", "不基于小说", "自由回答", "用通用知识")
GROUNDED_SIGNALS = ("小说", "原文", "书中", "这本书", "本书", "章节", "第几章", "主角", "人物", "剧情", "情节", "结局", "开头", "作者", "片段")
GENERAL_SIGNALS = (
    "rag", "langgraph", "langchain", "人工智能", "机器学习", "向量数据库", "postgresql", "mysql", "python", "java", "kettle",
    "编程", "代码", "天气", "几点", "几号",
)
GREETING = "^(你好|您好|嗨|哈喽|hello|hi|早上好|下午好|晚上好|谢谢|再见)[！!。,.，？?\\s]*$"
CREATIVE = "^(请)?(帮我)?(写|创作|翻译|润色|改写|推荐|起)(一|个|首|段|下)?"
ASSISTANT = "(你是谁|你能做什么|怎么使用(你|这个功能)?|使用帮助)"

REFERRING = ("他", "她", "它", "他们", "她们", "它们", "这", "那", "其", "此", "对方", "两人", "后来", "然后", "接着", "之后", "继续")
PRONOUNS = ("他", "她", "它", "他们", "她们", "它们", "此人", "对方", "两人", "自己")
IGNORABLE = "的了是在有和与吗呢啊吧？?！!。，,、 　\n"

RELATION_TRIGGERS = {
    "伴侣": ("双修伴侣", "道侣", "结为夫妻", "结成好事"),
    "师徒": ("师父", "师尊", "拜师", "恩师"),
    "亲属": ("父亲", "母亲", "哥哥", "弟弟", "姐姐", "妹妹"),
    "敌对": ("仇人", "死敌", "宿敌"),
}
RELATION_QUESTIONS = {
    "伴侣": ("伴侣", "道侣", "妻子", "老婆", "夫人", "情侣", "感情"),
    "师徒": ("师父", "师尊", "徒弟", "师承", "拜师"),
    "亲属": ("家人", "亲人", "父母", "兄弟姐妹", "家里"),
    "敌对": ("仇人", "敌人", "对手"),
}
EXEMPT_PHRASES = (
    "根据检索结果", "根据提供的片段", "根据以上片段", "根据原文", "综合来看", "从片段来看", "以下是", "整理如下",
    "无法确定", "无法回答", "没有提到", "未提及", "不足以",
    "希望对你有帮助", "希望这个回答", "很高兴为你", "祝你阅读愉快", "欢迎继续提问", "如果还有其他问题",
)

# Generated lists: what is taken off their lines, and between and around names.
LIST_MARK = "^(?:[-*•·]|[0-9]+[.、．)）])\\s*"
OUTER_QUOTES = "^(?:\"(.*)\"|「(.*)」|\u201c(.*)\u201d|'(.*)')$"
NAME_BREAKS = "[、,，。；;\\s]+"
NAME_EDGES = "^[.！!：:（）()「」《》]+|[.！!：:（）()「」《》]+$"

# Letters and digits of scripts with spaces between words, and of those without.
SPACED = (
    "A-Za-z0-9\\x{00c0}-\\x{00d6}\\x{00d8}-\\x{00f6}\\x{00f8}-\\x{024f}\\x{0370}-\\x{03ff}\\x{0400}-\\x{052f}"
    "\\x{0620}-\\x{0669}\\x{066e}-\\x{06d3}\\x{0900}-\\x{0963}\\x{0966}-\\x{097f}"
)
UNSPACED = "\\x{0e00}-\\x{0e5b}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{30fc}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}"
#: A sentence with its end marks, for paragraphs that are too long for a chunk.
SENTENCES = "[^。！？…；\n]*[。！？…；]+|[^。！？…；\n]+"
