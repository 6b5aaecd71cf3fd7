"""Fixed values of the domain: labels, weights, thresholds, word lists. They must equal what callers of the analytics expect."""

# Platform weights in the heat share.
PLATFORM_WEIGHTS = {"weibo": 1.2, "zhihu": 1.1, "baidu": 1.1, "toutiao": 1.0, "netease": 0.9, "sina": 0.8, "hupu": 0.8}
DEFAULT_WEIGHT = 1.0

# Period labels by the hour before which they end.
PERIODS = [(10, "MORN"), (14, "AM"), (20, "PM"), (24, "EVE")]
PERIOD_ORDER = ["MORN", "AM", "PM", "EVE"]

# Categories, in the order that breaks ties, with their display names.
CATEGORIES = {"entertainment": "娱乐八卦类事件", "current_affairs": "社会实事类事件", "sports_esports": "体育电竞类事件"}

# Platforms with their display names.
PLATFORM_LABELS = {
    "weibo": "微博", "zhihu": "知乎", "toutiao": "今日头条", "sina": "新浪新闻", "tencent": "腾讯新闻", "netease": "网易新闻",
    "baidu": "百度热搜", "hupu": "虎扑", "xiaohongshu": "小红书", "douyin": "抖音",
}

# What users call the platforms.
PLATFORM_ALIASES = {
    "微博": "weibo", "知乎": "zhihu", "头条": "toutiao", "今日头条": "toutiao", "新浪": "sina", "新浪新闻": "sina", "腾讯": "tencent", "腾讯新闻": "tencent",
    "网易": "netease", "网易新闻": "netease", "百度": "baidu", "百度热搜": "baidu", "虎扑": "hupu", "抖音": "douyin", "小红书": "xiaohongshu",
}

# Words that a query's keywords leave out.
STOPWORDS = [
    "最近", "最新", "新闻", "情况", "相关", "有哪些", "有什么", "什么", "关于", "事件", "热点", "消息", "动态",
    "进展", "现在", "今天", "昨日", "昨天", "前天", "今日", "谁", "哪里", "为何", "为什么", "怎么", "如何",
]

# Titles and marks of navigation links that are no news.
NOISE_TITLES = ["点击查看更多实时热点", "点击查看更多热点", "查看更多实时热点"]
NOISE_PREFIX, NOISE_PARTS, NOISE_URL = "点击查看更多", ["热点", "热榜"], "top_news_list"

# Keywords of the rule classifier, strong and medium.
KEYWORDS = {
    "entertainment": (
        ["明星", "娱乐", "八卦", "绯闻", "爆料", "综艺", "电影", "电视剧", "演员", "歌手", "偶像", "爱豆", "粉丝", "娱乐圈", "影视", "节目", "出轨", "离婚", "恋情", "结婚", "生子", "颁奖", "首映", "热播"],
        ["导演", "编剧", "制作人", "经纪人", "造型师", "剧组", "片场", "首播", "上映", "票房", "收视率", "口碑", "评分", "豆瓣"],
    ),
    "current_affairs": (
        ["政策", "法规", "政府", "国务院", "发改委", "司法", "法院", "检察", "公安", "警方", "事故", "案件", "民生", "舆情", "公共", "社会", "财经", "经济", "股市", "央行", "监管", "治理", "改革", "疫情"],
        ["会议", "通知", "公告", "声明", "调查", "处理", "整治", "专项", "民众", "市民", "居民", "群众", "网友", "热议", "关注", "讨论"],
    ),
    "sports_esports": (
        ["比赛", "联赛", "世界杯", "总决赛", "季后赛", "决赛", "半决赛", "球队", "球员", "教练", "俱乐部", "战队", "电竞", "赛事", "夺冠", "冠军", "亚军", "金牌", "银牌", "铜牌", "破纪录", "MVP"],
        ["足球", "篮球", "网球", "羽毛球", "乒乓球", "游泳", "田径", "体操", "LOL", "DOTA", "王者荣耀", "吃鸡", "CS", "转会", "签约", "续约"],
    ),
}
STRONG, MEDIUM, HUPU_BIAS, RULE_LEAST = 0.15, 0.05, 0.3, 0.2

# Thresholds.
CLUSTER_COSINE, CLUSTER_JACCARD, SAME_EVENT_CONFIDENCE, MERGE_CONFIDENCE = 0.80, 0.40, 0.80, 0.75
CANDIDATE_COSINE, CANDIDATES, CANDIDATE_DAYS, MIN_OCCURRENCE, MAX_GROUPS = 0.5, 3, 180, 2, 200
SEARCH_COSINE, SUMMARY_NODES, SUMMARY_HOURS = 0.7, 3, 6
CONTEXT_LIMIT, CONTEXT_SAFETY = 32_000, 2_000

#: Columns that a topic query may select or sort by.
VIEW_FIELDS = [
    "topic_id", "title", "summary", "first_seen", "last_active", "status", "category", "intensity_total", "heat_normalized", "echo_length_hours",
    "item_id", "item_title", "item_summary", "item_url", "item_platform", "item_published_at", "item_fetched_at",
]
