"""Patterns of questions that must match word for word; all fixed values, in order of preference."""

from __future__ import annotations

#: English words that searches leave out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as "
    "into through during before after above below between and or not no but if then else when where why how all each every both few more most other "
    "some such only own same so than too very just about also it its he she they them we us you me my your our their his her this that these those "
    "what which who whom"
).split()

#: Patterns of limits in Chinese, in English and in any language; a text's language says which count.
LIMITS_ZH = (
    r"前\s*(\d+)\s*(?:名|个|条|位|项|行|笔|大|多|的)",
    r"(?:取|只要)\s*(?:前\s*)?(\d+)\s*(?:名|个|条|位|项|行|笔)",
    r"限制\s*(\d+)",
    r"限量\s*(\d+)",
)
LIMITS_EN = (r"\b(?:top|first)\s+(\d+)", r"\b(\d+)\s+(?:results?|records?|rows?|items?)\b")
LIMITS_ANY = (r"\blimit\s+(\d+)", r"\btop\s*(\d+)")

#: Fixed values: (meaning, pattern) of times in Chinese; the first that a text holds counts.
TIMES_ZH = (
    ("day_before_yesterday", "前天"), ("yesterday", "昨天"), ("today", "今天"), ("day_after_tomorrow", "后天"), ("tomorrow", "明天"),
    ("this_week", "本周"), ("last_week", "上周"), ("next_week", "下周"),
    ("last_month", "上个月"), ("this_month", "本月|这个月"), ("next_month", "下个月"),
    ("this_quarter", "本季度|本季"), ("last_quarter", "上季度|上季"), ("next_quarter", "下季度|下季"),
    ("same_period_last_year", "去年同期"), ("last_year", "去年"), ("this_year", "今年|本年度?"), ("next_year", "明年"), ("ytd", "年初至今|本年至今|今年以来"),
    ("last_n_days", r"最近(\d+)天"), ("last_n_days", r"过去(\d+)天"), ("last_n_days", r"近(\d+)天"), ("last_n_weeks", r"最近(\d+)周"), ("last_n_weeks", r"过去(\d+)周"),
    ("last_n_months", r"最近(\d+)个?月"), ("last_n_months", r"过去(\d+)个?月"), ("last_n_years", r"最近(\d+)年"), ("last_n_years", r"过去(\d+)年"),
    ("n_days_ago", r"(\d+)天前"), ("n_weeks_ago", r"(\d+)周前"), ("n_months_ago", r"(\d+)个?月前"), ("n_years_ago", r"(\d+)年前"),
    ("next_n_days", r"未来(\d+)天"), ("next_n_weeks", r"未来(\d+)周"), ("next_n_months", r"未来(\d+)个?月"),
    ("absolute_ymd", r"(\d{4})年(\d{1,2})月(\d{1,2})日?"), ("absolute_ym", r"(\d{4})年(\d{1,2})月"),
    ("absolute_quarter", "q([1-4])(?:季度)?"), ("absolute_quarter", "第([一二三四1-4])季度"),
)
#: The same in English, in lower case.
TIMES_EN = (
    ("day_before_yesterday", "day before yesterday"), ("yesterday", "yesterday"), ("today", "today"), ("day_after_tomorrow", "day after tomorrow"), ("tomorrow", "tomorrow"),
    ("this_week", "this week"), ("last_week", "last week"), ("next_week", "next week"),
    ("last_month", "last month"), ("this_month", "this month"), ("next_month", "next month"),
    ("this_quarter", "this quarter"), ("last_quarter", "last quarter"), ("next_quarter", "next quarter"),
    ("same_period_last_year", "same period last year"), ("last_year", "last year"), ("this_year", "this year"), ("next_year", "next year"),
    ("ytd", r"year\s*to\s*date|ytd"), ("qtd", r"quarter\s*to\s*date|qtd"), ("mtd", r"month\s*to\s*date|mtd"),
    ("last_n_days", r"last (\d+) days?"), ("last_n_days", r"past (\d+) days?"), ("last_n_weeks", r"last (\d+) weeks?"), ("last_n_weeks", r"past (\d+) weeks?"),
    ("last_n_months", r"last (\d+) months?"), ("last_n_months", r"past (\d+) months?"), ("last_n_years", r"last (\d+) years?"), ("last_n_years", r"past (\d+) years?"),
    ("n_days_ago", r"(\d+) days? ago"), ("n_weeks_ago", r"(\d+) weeks? ago"), ("n_months_ago", r"(\d+) months? ago"), ("n_years_ago", r"(\d+) years? ago"),
    ("next_n_days", r"next (\d+) days?"), ("next_n_weeks", r"next (\d+) weeks?"), ("next_n_months", r"next (\d+) months?"),
)

#: By intent, (pattern, weight) for Chinese, for English and for both; case does not matter.
INTENTS = {
    "SELECT": (
        (("查询", 2), ("查看", 2), ("列出", 2), ("显示", 1), ("找一下?", 1), ("帮我查", 2), ("获取", 1), ("给我", 1), ("有哪些", 1), ("是什么", 1)),
        ((r"\bfind\b", 2), (r"\blist\b", 2), (r"\bshow\b", 1), (r"\bget\b", 1), (r"\bretrieve\b", 2), (r"\bdisplay\b", 1), (r"\bfetch\b", 1), (r"\blook\s*up\b", 1), (r"\bsearch\b", 1)),
        ((r"\bselect\b", 3), (r"\bfrom\b", 2), (r"\bwhere\b", 2)),
    ),
    "AGGREGATE": (
        (
            ("统计", 3), ("汇总", 3), ("总计", 3), ("合计", 2), ("平均", 2), ("求和", 2), ("计数", 2), ("最大值", 2), ("最小值", 2), ("排名", 2), ("分组", 2), ("各(个|种|类)", 1),
            ("每(个|种|类|一)", 1), ("分别", 1), ("按.*分组", 2),
        ),
        (
            (r"\bcount\b", 3), (r"\bsum\b", 3), (r"\baverage\b", 3), (r"\bavg\b", 3), (r"\btotal\b", 3), (r"\baggregate\b", 3), (r"\bmax\b", 2), (r"\bmin\b", 2), (r"\brank\b", 2),
            (r"\bgroup\s*by\b", 3), (r"\bsummary\b", 2), (r"\bbreakdown\b", 2), (r"\bhow many\b", 2), (r"\bhow much\b", 2), (r"per\b", 1),
        ),
        (),
    ),
    "JOIN": (
        (
            ("关联", 3), ("联合", 2), ("连接", 1), ("一起", 1), ("对应.*表", 2), ("跨表", 2), ("多表", 2),
            ("每(?:个|位|名|人|条|项).{1,8}的.{1,8}(?:总|平均|汇总|统计|金额|价格|排名|列表|详情|记录)", 2), ("每(?:个|种|类|位|条|项|名).{1,6}的.{1,6}", 1),
            ("谁.{0,8}(?:购买|下单|订购|消费|支付|浏览|评价|投诉|退货|取消)", 2), (".{1,4}(?:属于|归属|拥有|持有).{1,6}", 2), (".{1,4}(?:包含|包括).{1,4}", 1),
            ("(?:哪个|哪些|什么).{1,6}(?:下|有|包含|拥有)", 2), ("分别.{0,4}(?:统计|查询|列出|显示|汇总|计算|查看)", 2),
        ),
        (
            (r"\b(?:each|every|per)\s+\w+\s+(?:has|have|with|in)\s+\w+\s+(?:total|sum|count|avg)", 2), (r"\bwho\s+(?:has|have|made|placed|ordered|bought|purchased)", 2),
            (r"\bwhich\s+\w+\s+(?:has|have|contains?|belongs?\s+to)", 2), (r"\bjoin\b", 3), (r"\btogether with\b", 2), (r"\bacross\b", 1), (r"\brelated\b", 1), (r"\bcombine\b", 2),
            (r"\bcorrelate\b", 2), (r"\bmultiple tables?\b", 2),
        ),
        (),
    ),
    "COMPARISON": (
        (("对比", 3), ("比较", 3), ("大于", 2), ("小于", 2), ("高于", 2), ("低于", 2), ("超过", 1), ("相比", 2), ("哪个.*更", 2), ("差异", 1), (r"\bvs\b", 2)),
        (
            (r"\bcompare\b", 3), (r"\bversus\b", 3), (r"\bvs\b", 2), (r"\bgreater than\b", 2), (r"\bless than\b", 2), (r"\bhigher than\b", 2), (r"\blower than\b", 2),
            (r"\bmore than\b", 1), (r"\bdifference\b", 1), (r"\bcomparison\b", 3), (r"\bratio\b", 1),
        ),
        ((">", 1), ("<", 1), (">=", 1), ("<=", 1)),
    ),
    "TIME_SERIES": (
        (
            ("趋势", 3), ("变化", 2), ("走势", 3), ("按月", 3), ("按天", 3), ("按周", 3), ("按季度", 3), ("按年", 3), ("同比", 3), ("环比", 3), ("增长", 1), ("下降", 1), ("时间序列", 3),
            ("每天", 2), ("每月", 2), ("每年", 2), ("逐[日周月季年]", 3),
        ),
        (
            (r"\btrends?\b", 3), (r"\bover time\b", 3), (r"\bmonthly\b", 3), (r"\bdaily\b", 3), (r"\bweekly\b", 3), (r"\bquarterly\b", 3), (r"\byearly\b", 3), (r"\bgrowth\b", 1),
            (r"\bdecline\b", 1), (r"\bchange over\b", 2), (r"\btime series\b", 3), (r"\bhistorical\b", 2), (r"\bday over day\b", 3), (r"\bmonth over month\b", 3),
            (r"\byear over year\b", 3), (r"\byoy\b", 3), (r"\bmom\b", 3), (r"\bdod\b", 3),
        ),
        (),
    ),
    "FUNNEL": (
        (("转化", 3), ("漏斗", 3), ("转化率", 3), ("留存", 3), ("流失", 3), ("留存率", 3), ("流失率", 3), ("跳出", 2)),
        (
            (r"\bfunnel\b", 3), (r"\bconversion\b", 3), (r"\bretention\b", 3), (r"\bchurn\b", 3), (r"\battrition\b", 3), (r"\bdrop[\s-]*off\b", 3), (r"\bbounce\b", 2),
            (r"\bopt[\s-]*in\b", 2), (r"\bopt[\s-]*out\b", 2),
        ),
        (),
    ),
}
#: Of intents with equal sums, the first here.
PRIORITY = ("FUNNEL", "TIME_SERIES", "AGGREGATE", "COMPARISON", "JOIN", "SELECT")

#: Fixed values: (language, direction or "" where none is said, pattern) that order by the column in its group.
ORDERS = (
    ("zh", "ASC", r"(?:按|按照|根据|以)\s*(\S+?)\s*(?:升序|递增|从小到大|从低到高)"),
    ("zh", "DESC", r"(?:按|按照|根据|以)\s*(\S+?)\s*(?:降序|递减|从大到小|从高到低)"),
    ("zh", "", r"(?:按|按照|根据|以)\s*((?:(?!升序|降序|递增|递减|从[大小高低]|排序|排列)\S)+)\s*(?:排序|排列)"),
    ("zh", "DESC", r"(\S+?)(?:最高|最大|最多|最快|最好|最长)"),
    ("zh", "ASC", r"(\S+?)(?:最低|最小|最少|最慢|最差|最短)"),
    ("en", "ASC", r"\b(?:order(?:ed)?\s+by|sort(?:ed)?\s+by)\s+(\S+)\s+(?:asc|ascending)"),
    ("en", "DESC", r"\b(?:order(?:ed)?\s+by|sort(?:ed)?\s+by)\s+(\S+)\s+(?:desc|descending)"),
    ("en", "", r"\b(?:order(?:ed)?\s+by|sort(?:ed)?\s+by)\s+(\S++)(?!\s*(?:desc|descending|asc|ascending))"),
    ("en", "DESC", r"\b(?:highest|maximum|most|greatest)\s+(\S+)"),
    ("en", "ASC", r"\b(?:lowest|minimum|least)\s+(\S+)"),
)

#: Fixed values: (aspect, pattern) of words that may mean several columns, measures or spans; case does not matter.
AMBIGUITIES = (
    ("attribute", r"(?:各个?|每个?|不同|按|根据|依照)\s*(?:的)?\s*(地区|区域|城市|省份)"),
    ("attribute", r"(?:按|根据|依照)\s*(名称|名字|标题)"),
    ("attribute", r"(?:按|根据|依照)\s*(类型|类别|种类|分类)"),
    ("attribute", r"(?:按|根据|依照)\s*(日期|时间)"),
    ("attribute", r"(?:按|根据|依照)\s*(状态)"),
    ("attribute", r"(?:按|根据|依照)\s*(级别|等级|层级)"),
    ("attribute", r"(?:按|根据|依照)\s*(id|编号|代码|编码)"),
    ("attribute", r"\b(?:by|per|for each|different)\s+(region|city|cities|area|location)\b"),
    ("attribute", r"\b(?:by|per)\s+(name|title)\b"),
    ("attribute", r"\b(?:by|per)\s+(type|category|kind|class)\b"),
    ("attribute", r"\b(?:by|per)\s+(date|time)\b"),
    ("attribute", r"\b(?:by|per)\s+(status|state)\b"),
    ("attribute", r"\b(?:by|per)\s+(level|tier|grade)\b"),
    ("attribute", r"\b(?:by|per)\s+(id|code)\b"),
    ("aggregation", r"平均(?:值|数|金额|价格|工资|收入|年龄|时长|时间)?"),
    ("aggregation", r"排名|排行|第.*名|前\d+名"),
    ("aggregation", r"(?:占比|比例|百分比|份额)"),
    ("aggregation", r"分组|归类"),
    ("aggregation", r"\baverage\b"),
    ("aggregation", r"\brank(?:ing)?\b"),
    ("aggregation", r"\bpercent(?:age|ile)?\b|\bratio\b"),
    ("aggregation", r"\bgroup\b"),
    ("range", r"(大额|大单|大宗)(?:订单|交易|客户|采购)?"),
    ("range", r"(高价值|高净值|高客单价|优质|重点|vip|核心)(?:客户|用户|订单|商品|产品)?"),
    ("range", r"(高价|高端|高档)(?:商品|产品|客户|市场)?"),
    ("range", r"(低价值|低端|低档|劣质)(?:客户|商品|产品)?"),
    ("range", r"(?:高|低)(?:评分|评价|信用|信誉|热度|活跃度)"),
    ("range", r"\bhigh[\s-]value\b"),
    ("range", r"\bpremium\b|\bvip\b|\btop[\s-]tier\b"),
    ("range", r"\b(?:big|large|major)\s+(?:orders?|customers?|clients?|deals?)\b"),
    ("range", r"\b(?:small|minor)\s+(?:orders?|customers?|clients?)\b"),
    ("range", r"\b(?:high|low)[\s-](?:score|rat(?:ing|ed)|credit)\b"),
    ("temporal", r"最近(?!\s*(?:\d+|一|两|三|四|五|六|七|八|九|十|几|数|多)\s*个?\s*的?\s*(?:天|周|星期|月|季度|年|小时|分钟))"),
    ("temporal", r"近期|近来"),
    ("temporal", r"过去(?!\s*(?:\d+|一|两|三|四|五|六|七|八|九|十|几|数|多)\s*个?\s*的?\s*(?:天|周|星期|月|季度|年|小时|分钟))"),
    ("temporal", r"以往|历史上"),
    ("temporal", r"历史(?!\s*(?:\d+|一|两|几|数)\s*个?\s*的?\s*(?:天|周|月|季度|年))"),
    ("temporal", r"\brecent(?:ly)?\b(?!\s+\d+\s*(?:day|week|month|year|hour)s?)"),
    ("temporal", r"\blately\b|\bof late\b"),
    ("temporal", r"\bpast\b(?!\s+\d+\s*(?:day|week|month|year|hour)s?)"),
    ("temporal", r"\bhistorical\b(?!\s+\d+\s*(?:day|week|month|year)s?)"),
)

#: Fixed values: (complexity, pattern) of questions in lower case, first match wins; else simple.
COMPLEXITY = (
    ("multi_step", r"然后|再|接着|之后|第二步|第三步"),
    ("multi_step", r"first.*then|after.*then|step\s*\d|next.*then"),
    ("multi_step", r"分别|各自|separately|respectively|each"),
    ("ambiguous", r"或者|还是|要么|不确定|大概|也许|可能"),
    ("ambiguous", r"or maybe|either|not sure|perhaps|maybe|approximately"),
    ("complex", r"\bjoin\b|\bcte\b|\bwindow\b|子查询|嵌套|窗口函数|递归"),
    ("complex", r"\bgroup\s+by\b.*\bhaving\b|\bpartition\b|\bover\b"),
    ("complex", r"对比|比较|同比|环比|vs|versus|compared?\s+to"),
    ("complex", r"排名|排行|前\d+|top\s*\d+|rank|dense_rank"),
    ("medium", r"\bjoin\b|关联|联合"),
    ("medium", r"\bgroup\s+by\b|分组|汇总|统计|sum|avg|count"),
    ("medium", r"趋势|变化|走势|trend|monthly|daily|weekly"),
)
#: Fixed values: (plan, pattern) of SQL texts and questions in lower case, first match wins; else default.
PLANS = (
    ("gensql_agentic", r"\bjoin\b"),
    ("gensql_agentic", r"\bgroup\s+by\b"),
    ("gensql_agentic", r"\bhaving\b"),
    ("gensql_agentic", r"\bunion\b|\bintersect\b|\bexcept\b"),
    ("gensql_agentic", r"\bsubquery\b|\b子查询\b|\(\s*select\b"),
    ("gensql_agentic", r"\bcase\s+when\b|\bwindow\b|\bover\s*\(|row_number|rank\s*\(|dense_rank"),
    ("gensql_agentic", r"[一-鿿]*?(?:关联|多表|跨表|联合|连接)[一-鿿]*"),
    ("gensql_agentic", r"[一-鿿]*?(?:复杂|分析|对比|比较|同比|环比|占比)[一-鿿]*"),
    ("ez_query", r"^(?:select\s+)?\*\s+from\s+[\w一-鿿]+\s*$"),
    ("ez_query", r"^(?:select\s+)?[\w一-鿿]+(,\s*[\w一-鿿]+)*\s+from\s+[\w一-鿿]+\s*$"),
    ("ez_query", r"^(?:查看|显示|列出|show|list|display|get)\s*[\w一-鿿]+"),
    ("ez_query", r"^(?:select\s+)?count\(\*\)"),
    ("ez_query", r"^\s*(?:什么|哪个|多少|怎么|how|what|which|when|who)"),
)
