"""Word lists and patterns of the domain.

Fixed values: results depend on each of them, so they are given as they are.
"""

NOISE_PATTERNS = (
    r"^表\s*\d+",
    r"^图\s*\d+",
    r"^第[一二三四五六七八九十\d]+[章节篇]?.*",
    r"^\d+[-–]\d+",
    r"^[A-Za-z]{1,3}$",
    r"^[+\-]",
    r".*[A-Za-z][+\-].*",
    r".*\d.*单位时间内.*",
)
NOISE_MARKERS = ("见表", "见图", "思考题", "二维码", "数字资源")
BAD_FRAGMENTS = (
    "见表", "因素", "本章", "本节", "思考题", "数字资源", "二维码", "需要指出", "值得注意", "值得一提", "主要", "尤其", "特别", "教材", "前言", "第版", "一流本科", "新增", "编写", "出版社", "第一章",
    "第二章", "第三章", "第四章", "第五章", "绪论", "因此他", "公元前", "称为", "也称", "并不", "总", "属于", "组成", "底物", "最大", "一种小", "通常指", "实质上", "胞质侧", "招募", "转接", "生理学家",
    "转录因子", "单位时间内", "向上为", "外向驱动力", "内流", "外流", "进行了", "调控特定", "便可", "可逆性损伤", "制不同", "垂体促",
)
BAD_PREFIXES = (
    "如", "例如", "一种", "通常指", "在", "由", "对", "与", "将", "使", "可", "能", "和", "并", "且", "以及", "具有", "含有", "激活", "致", "便",
)
VERB_PHRASE_MARKERS = (
    "参与", "调节", "促进", "抑制", "引起", "导致", "形成", "发生", "产生", "释放", "分泌", "转运", "招募", "结合", "具有", "含有", "激活", "致", "潴留", "进行", "调控",
)
CONCEPT_SUFFIXES = (
    "概念", "理论", "定理", "方法", "现象", "机制", "过程", "反应", "调节", "系统", "结构", "功能", "细胞", "组织", "器官", "因子", "激素", "受体", "蛋白", "酶", "通道", "电位", "反射", "循环",
    "血压", "血流", "神经", "动脉", "静脉", "血管", "筋膜", "韧带", "间隙", "窦", "腺", "管", "肌", "骨",
)
PERSON_NAME_MARKERS = ("学家", "作者", "教授", "博士", "院士")
PRONOUN_FRAGMENTS = ("该", "这", "此", "其")
SHORT_CONCEPTS = frozenset((
    "稳态", "血型", "血压", "血浆", "血液", "前囟", "后囟", "翼点", "腮腺", "乳房", "肾门", "肝门", "会阴",
))
SHORT_ENDINGS = ("肌", "骨", "膜", "管", "腺", "窦")
FRONT_MATTER = ("前言", "教材", "出版", "编写", "数字资源")
GENERAL_SUFFIXES = ("系统", "组织", "结构", "过程", "机制", "反应", "调节", "循环", "血管", "神经")

QUESTION_STOPWORDS = (
    "这个", "概念", "核心", "定义", "是什么", "什么", "请问", "教材", "知识点", "相关", "说明", "解释", "简述",
)
NO_ANSWER = "当前知识库中未找到相关信息"
DEFINITION_QUESTION = ("定义", "是什么", "什么是", "概念")
DEFINITION_CUES = ("是", "指", "属于", "称为", "来自", "分泌", "组成", "包括", "主要")
ACTION_CUES = ("作用", "调节", "影响", "促进", "抑制")
KEEP_WORDS = ("保留", "不应该删除", "keep")
SPLIT_WORDS = ("分开", "拆分", "不是同一个")

# Candidate names: replacements in this order, then brackets, suffixes and heads (operators/terms.py).
NAME_CLEANING = (
    (r"\s+", ""),
    (r"[：:，,。；;、]+$", ""),
    (r"^[\[\]【】“”\"' ]+|[\[\]【】“”\"' ]+$", ""),
    (r"^(?:如|例如|即|其中|所谓|一种|通常指|和|与|及|以及|由|对|将|使|具有|含有)", ""),
    (r"^.*?(?=电压钳|膜片钳|钠通道|钾通道|钙通道)", ""),
    (r"^.*由(?=[一-鿿]{1,10}(?:细胞|小球|蛋白|通道|受体|激素|系统|结构|组织|器官))", ""),
    (r"(?:实质上|通常指|主要是|可见|需)$", ""),
)
KNOWN_HEADS = r"^.*?(?=肝细胞|红细胞|白细胞|血小板|胰岛素|肾上腺素|甲状腺|腮腺|面神经|三叉神经)"
LOOSE_ENDINGS = "（(需见和与的为在中及或等"
REJECTED_STARTS = (
    "因素", "这", "该", "其", "此", "上述", "下列", "本章", "本节", "称为", "也称", "简称", "因此", "约公元", "第一章", "第二章", "第三章", "第四章",
)
REJECTED_PARTS = ("第一章", "第二章", "第三章", "第四章", "绪论")
SENTENCE_PARTS = ("是", "的", "并不", "之", "所", "属于", "组成", "总")
GLOSS_PATTERNS = (
    r"([一-鿿][一-鿿·\-]{1,12})[（(][A-Za-z][A-Za-z0-9+\- /,，]{1,50}[）)]",
    r"([一-鿿][一-鿿·\-]{1,12})[（(][一-鿿]{1,12}(?:条件下|状态下|阶段|类型|形式)?[）)]",
    r"[A-Za-z][A-Za-z0-9+\- /]{1,50}[，,]\s*([一-鿿]{2,12})",
)
DEFINITION_PATTERN = r"(?:^|[。；\n])([一-鿿][一-鿿·\-]{1,10})(?:是指|是|指|称为|又称|定义为)"
ENUMERATION = (r"^[（(]?[一二三四五六七八九十\d]+[）)、.．]\s*", r"^第[一二三四五六七八九十\d]+节\s*[|｜]?\s*")

# Relations: what stands between two names, at most so many characters without a sentence end before and after.
CONTAINS_WORDS, PART_WORDS = ("包括|包含|分为|由.+组成|可分为", 28, 36), ("属于|是.+组成部分|为.+之一", 18, 24)
BASIS_WORDS = ("基础|前提", 28, 28)
APPLIES_WORDS, RELIES_WORDS = ("应用于|用于|参与|调节|影响|抑制|促进", 28, 36), ("依赖|通过|利用", 28, 36)
AND_WORDS = ("和|与|及|或|、", 18, 18)

# Questions.
TEMPLATES = {
    "definition": "{term}这个概念的核心定义是什么？",
    "source": "{term}主要出现在哪一章？请给出原文依据。",
    "fact": "教材中关于{term}的关键表述是什么？",
    "compare": "{term}与同一章节中的相关概念有什么联系？",
    "reasoning": "根据教材上下文，{term}为什么重要？请基于原文说明。",
    "cross_textbook": "不同教材中关于{term}的表述在哪里？请给出可追溯来源。",
}
KINDS = ("definition", "fact", "source", "compare", "reasoning")
SEEDS = (
    "内环境", "稳态", "兴奋性", "新陈代谢", "神经调节", "体液调节", "正反馈", "负反馈", "前馈控制", "细胞膜", "钠泵", "动作电位", "阈电位", "信号转导", "受体", "离子通道", "红细胞", "白细胞", "血小板",
    "血液凝固", "血浆", "心动周期", "心输出量", "动脉血压", "微循环", "肾上腺素", "胰岛素", "胰高血糖素", "甲状腺激素", "血管升压素", "腮腺", "腮腺管", "三叉神经", "面神经", "翼静脉丛", "海绵窦", "颈动脉窦",
    "颈内静脉", "胸锁乳突肌", "浅筋膜", "深筋膜", "颈筋膜", "膈神经", "迷走神经", "胸导管", "乳房", "肝门静脉", "肾门", "输尿管", "前列腺", "正中神经", "尺神经", "桡神经", "腓深神经",
)
TERM_STOPWORDS = frozenset((
    "主要", "尤其", "特别", "通常", "可能", "需要", "可以", "这些", "这就", "这也", "其中", "前者", "后者", "另一种", "另一类", "因此", "由于", "如果", "教材", "版教材", "电子教材", "新形态教材",
    "研究", "功能", "活动", "观察", "解剖", "通过", "抑制", "促进", "释放", "导致", "引起", "形成", "生成", "正常", "临床上", "上述", "式中", "根据", "启动", "激活", "测定", "刺激", "中枢", "分别",
    "血中", "血浆中", "血液中", "血浆", "血液", "受体", "蛋白", "动脉", "静脉", "血管", "韧带", "作用", "排出", "重要", "信息", "吸收", "调节", "状态", "出来", "分区", "第一节", "第二节", "第三节",
    "第四节", "值得注意", "但研究目", "压均", "优化", "更多", "两侧", "浅层结构", "整体水平研究", "人体生理研究", "慢性实验", "动物实验",
))
TERM_BLOCKLIST = "习近平|总书记|课程思政|教材编写|编写修订|医学教育|人民卫生出版社|科学家们|高等学校|数字资源|思考题|二维码|出版|责任编辑|版权"
SOURCE_BLOCKLIST = "习近平|课程思政|教材编写|编写修订|新形态教材|电子教材|人民卫生出版社|版权所有"
TERM_SUFFIXES = (
    "神经", "动脉", "静脉", "血管", "淋巴结", "淋巴", "韧带", "筋膜", "关节", "骨", "肌", "膜", "腺", "管", "细胞", "受体", "蛋白", "激素", "酶", "因子", "电位", "反射", "系统", "组织", "器官",
    "循环", "血液", "血压", "通道", "小管", "小球", "髓质", "皮质", "素",
)
SHORT_TERMS = frozenset((
    "稳态", "血型", "血压", "血流", "血浆", "血液", "心率", "心音", "反射", "前囟", "后囟", "舌骨", "翼点", "乳房", "会阴", "肾门", "肝门",
))
CONCEPT_KEYWORDS = (
    "内环境", "内分泌", "兴奋性", "稳态", "反馈", "前馈", "反射", "代谢", "凝血", "通气", "换气", "滤过", "重吸收", "分泌", "排卵", "生殖", "牵涉痛",
)
TERM_LEAD = r"^[一-龥]{0,4}(?:其|该|此|为|在|由|使|将|把|被|和|与|及|或|有|从|对|向)"
TERM_EDGES, TERM_EDGES_AGAIN = "的一是在和与、，。；：；（）()[]【】", "的一是在和与、，。；：；"
TERM_OPENERS = r"^(?:主要|可见|因此|由于|例如|通过|促进|抑制|影响|分泌|释放|进入|来自|这些|后者|前者|其中|一般|正常)"
TERM_REFERENCES = r"第[一二三四五六七八九十\d]+章|图\d*|表\d*|本章|本节|本书"
TERM_STARTS = (
    "于", "从", "对", "向", "使", "可", "有", "无", "不能", "促成", "称为", "结合", "分泌", "释放", "观察", "解剖", "保留", "第",
)
TERM_ENDS = (
    "的", "了", "也", "都", "就", "可", "能", "主要", "尤其", "特别", "通常", "中", "时", "对",
)
LONG_TERM_ENDS = ("系统", "综合征", "生长因子", "氨酸", "静脉", "动脉", "神经", "激素", "受体")
SHORT_TERM_ENDS = ("骨", "肌", "膜", "腺", "管", "酶", "素")
ENTITY_STARTS = (
    "有", "从", "对", "向", "使", "将", "其", "此", "该", "于", "在", "和", "与", "可", "不", "被",
)
ENTITY_PARTS = ("的", "可以", "进行", "观察", "解剖", "损伤", "覆盖", "分泌", "释放")
TITLE_TERM = r"(?:^|\n)\s*(?:[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\d]+[）)])\s*([一-鿿]{2,10})(?:\s|$|[（(])"
TERM_PATTERNS = (
    r"([一-鿿][一-鿿·\-]{1,9})[（(][A-Za-z][A-Za-z0-9+\- /,，]+[）)]",
    r"([A-Za-z0-9+\- ]{2,40})[，,]\s*([一-鿿]{2,10})",
    r"(?:^|[，。；：、\s])([一-鿿]{2,8})(?:是指|是指一种|是|称为)",
    r"称为([一-鿿]{2,8})",
)
GRAPH_TERM_STARTS = (
    "有", "出", "从", "对", "向", "切", "保留", "不能", "型", "组", "左", "右", "上", "下",
)
GRAPH_TERM_PARTS = "损伤|观察|解剖|覆盖|指尖|手掌|进入|来自|离断|追踪|汇入|排列|相续|受损|困难|较多|危险"
GRAPH_TERM_GENERAL = frozenset((
    "系统", "细胞", "组织", "器官", "血管", "神经", "动脉", "静脉", "韧带", "肌", "膜", "腺", "管",
))
