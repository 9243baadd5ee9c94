"""Term lists and code tables results depend on, in their natural order."""

# Event types with the terms that name them; the first type with a hit wins.
EVENT_TERMS = (
    ("GUIDANCE", ("guidance", "outlook", "forecast", "전망", "가이던스", "실적전망")),
    ("BUYBACK", ("buyback", "share repurchase", "자사주", "자기주식취득", "자기주식처분")),
    ("DIVIDEND", ("dividend", "배당", "현금배당")),
    ("M&A", ("merger", "acquisition", "acquire", "takeover", "합병", "인수", "영업양수", "영업양도")),
    ("SUPPLY_CONTRACT", ("supply contract", "contract win", "공급계약", "수주", "단일판매", "계약체결")),
    ("LAWSUIT", ("lawsuit", "litigation", "legal proceeding", "소송", "피소", "중재")),
    ("CAPITAL_RAISE", ("capital raise", "offering", "rights issue", "유상증자", "무상증자", "전환사채", "신주인수권")),
    ("MANAGEMENT_CHANGE", ("chief executive", "ceo", "director resign", "임원", "대표이사", "경영진", "사임")),
    ("CORPORATE_ACTION", ("stock split", "reverse split", "tender offer", "분할", "주식병합", "감자", "공개매수")),
    ("EARNINGS", ("earnings", "results of operations", "quarterly report", "annual report", "실적", "잠정",
                  "분기보고서", "반기보고서", "사업보고서")),
    ("REGULATION", ("regulation", "regulator", "antitrust", "규제", "감독당국", "공정위")),
    ("PRODUCT", ("product launch", "new product", "출시", "신제품")),
    ("TECHNOLOGY", ("technology", "patent", "semiconductor process", "기술", "특허", "공정")),
    ("CYBER", ("cyberattack", "ransomware", "data breach", "사이버", "랜섬웨어", "정보유출")),
    ("SANCTION", ("sanction", "export control", "제재", "수출통제")),
    ("TARIFF", ("tariff", "관세")),
    ("INTEREST_RATE", ("interest rate", "rate cut", "rate hike", "금리", "기준금리")),
    ("FX", ("foreign exchange", "currency", "exchange rate", "환율", "달러", "원화")),
    ("COMMODITY", ("commodity", "crude oil", "natural gas", "원자재", "유가", "천연가스")),
    ("GEOPOLITICS", ("geopolit", "war", "missile", "invasion", "지정학", "전쟁", "미사일", "침공")),
)
EARNINGS_FORMS = ("10-Q", "10-K", "10-Q/A", "10-K/A")
ITEM_TYPES = (("2.02", "EARNINGS"), ("2.01", "M&A"), ("3.02", "CAPITAL_RAISE"), ("5.02", "MANAGEMENT_CHANGE"))

# Scope terms, from the widest scope down.
GLOBAL_TERMS = ("war", "missile", "invasion", "earthquake", "flood", "geopolit", "전쟁", "미사일", "침공", "지진", "홍수")
MACRO_TERMS = ("interest rate", "rate cut", "rate hike", "inflation", "foreign exchange", "환율", "금리", "물가", "중앙은행")
MARKET_TERMS = ("stock market", "wall street", "kospi", "kosdaq", "nasdaq", "증시", "주식시장")

# Source grades: official filings, news search, everything else.
OFFICIAL_SOURCES = ("OPENDART", "SEC_EDGAR")
NEWS_SOURCES = ("NAVER_NEWS", "GOOGLE_NEWS_RSS")

TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")

TITLE_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "at", "with", "from",
    "is", "are", "as", "by", "after", "before", "says", "said", "new", "update",
    "대한", "관련", "및", "으로", "에서", "한다", "했다", "공시", "속보",
)
NUMBER_UNITS = ("조원", "억원", "만원", "원", "trillion", "billion", "million", "bn", "mn", "%", "percent", "usd", "krw")

# Headline sentiment and risk terms; hits are substrings.
POSITIVE_TERMS = (
    "beat", "beats", "upgrade", "upgraded", "surge", "rally", "record profit", "growth", "strong demand",
    "raises outlook", "approval", "contract win", "partnership", "buyback", "dividend increase", "recovery",
    "호실적", "상향", "급등", "반등", "수주", "계약", "승인", "성장", "회복", "증가", "흑자", "사상 최대",
)
NEGATIVE_TERMS = (
    "miss", "misses", "downgrade", "cut outlook", "plunge", "slump", "layoff", "lawsuit", "probe", "recall",
    "default", "bankruptcy", "weak demand", "decline", "loss", "fraud", "restriction", "ban",
    "실적 부진", "하향", "급락", "감소", "적자", "소송", "조사", "리콜", "규제", "제재", "파산", "부진",
)
RISK_TERMS = (
    "war", "missile", "attack", "sanction", "tariff", "earthquake", "flood", "wildfire", "cyberattack",
    "strike", "blockade", "supply disruption", "emergency", "conflict", "invasion", "explosion",
    "전쟁", "미사일", "공격", "제재", "관세", "지진", "홍수", "산불", "사이버 공격", "파업", "봉쇄", "공급 차질",
)
STRONG_RISK_TERMS = ("war", "invasion", "missile", "blockade", "전쟁", "침공", "미사일", "봉쇄")

# Company relevance.
GENERIC_NAMES = ("apple", "삼성", "samsung")
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "limited", "주식회사")
CORPORATE_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "limited",
    "electronics", "motor", "motors", "전자", "주식회사", "하이닉스", "현대차", "현대자동차",
)
IMPACT_TERMS = (
    "earnings", "revenue", "profit", "guidance", "forecast", "shares", "stock", "company",
    "contract", "acquisition", "merger", "lawsuit", "regulator", "launch", "announces",
    "iphone", "ipad", "mac", "tim cook", "실적", "매출", "영업이익", "순이익", "주가",
    "주식", "공시", "계약", "수주", "인수", "합병", "소송", "규제", "출시", "발표",
)
PRODUCT_ONLY = {"MSFT": ("microsoft office", "office 365 tips", "windows keyboard shortcut")}
AFFILIATE_GUARD = {
    "symbol": "005930", "name": "삼성전자",
    "affiliates": (
        "삼성생명", "삼성화재", "삼성물산", "삼성중공업", "삼성증권", "삼성카드",
        "삼성바이오로직스", "삼성에스디에스", "samsung life", "samsung c&t",
        "samsung heavy industries", "samsung securities", "samsung biologics",
    ),
}
US_CONTEXT_TERMS = ("federal reserve", "fed ", "wall street", "nasdaq", "s p 500", "united states", "미국")
KR_CONTEXT_TERMS = ("kospi", "kosdaq", "korea", "한국", "코스피", "코스닥", "한국은행")
SUPPLY_CHAIN_TERMS = ("semiconductor", "chip", "shipping", "oil", "supply chain", "반도체", "해운", "유가", "공급망")
DISTANT_TERMS = ("nepal", "네팔")
CHIP_TERMS = ("semiconductor", "chip", "반도체", "electronics", "전자")

# Closed sets of the event record.
EVENT_TYPES = tuple(t for t, _ in EVENT_TERMS) + ("OTHER",)
TRUST_LEVELS = ("TRUSTED", "PARTIALLY_TRUSTED", "EXPLORATORY", "NOT_EVALUABLE")
EVENT_SCOPES = ("COMPANY", "SECTOR", "MARKET", "MACRO", "GLOBAL_EVENT")
RELEVANCE_STATUSES = (
    "DIRECT_COMPANY", "INDIRECT_PRODUCT", "SECTOR_CANDIDATE", "GLOBAL_CANDIDATE", "REJECTED_GENERIC", "UNASSESSED",
)

# Universe filters.
EXCLUDED_NAME = (
    r"(?iU)\b(ETF|ETN|ETP|WARRANTS?|RIGHTS?|UNITS?|PREFERRED|PREF|ACQUISITION CORP|ACQUISITION CO|SPAC|DEBENTURE|"
    r"NOTE DUE|2X|3X|INVERSE|ULTRA(SHORT)?)\b|상장지수|워런트|우선주|기업인수목적"
)
EXCLUDED_SYMBOL = r"(?i)(?:\.WS|\.W|\.U|\.R|\.PR[A-Z]?|-P[A-Z]?)$"
US_EXCHANGES = ("NASDAQ", "NYSE", "AMEX")
US_PROXIES = ("SPY", "QQQ")
CLASS_SHARES = {
    "BRK.B": "BRKB", "BRK-B": "BRKB", "BRK/B": "BRKB", "BRKB": "BRKB",
    "BRK.A": "BRKA", "BRK-A": "BRKA", "BRK/A": "BRKA", "BRKA": "BRKA",
}
BOARD_NAMES = {"KOSPI": "거래소", "KOSDAQ": "코스닥"}
STATUS_RISKS = ("관리종목", "정리매매", "거래정지", "투자위험")
INDEX_ALIASES = {"KOSPI": ("KOSPI", "코스피", "종합주가지수"), "KOSDAQ": ("KOSDAQ", "코스닥", "코스닥종합")}
