"""Term tables of the notice domain.  They are the defaults of expressions that take terms as parameters."""

# Keywords of items, repeats included since each of them counts, and words that veto an item.
KEYWORDS = (
    "모듈러", "OSC", "공업화주택", "프리패브", "프리팹", "조립식", "이동식", "이동식 주택", "임시", "숙소", "스마트건설", "DfMA",
    "PC 모듈러", "스틸 모듈러", "군간부숙소", "병영생활관", "간부숙소", "독신자숙소", "생활관", "막사", "관사", "기숙사", "학교",
    "학교 모듈러", "임시교사", "시설공사", "시설", "행복주택", "매입임대", "공공임대", "모듈러교실", "임시교사", "가설교실", "임시교실",
    "이동식교실", "모듈러 교실", "제작·설치", "제작 설치", "임차용역", "임대용역", "임대형", "학교 모듈러", "교육청 모듈러",
)
VETOES = ("장난감", "완구", "가구 부품", "소형 박스", "소형부품", "모형", "부품상자")
NEWS_VETOES = ("게임", "완구", "장난감", "자동차 모듈", "전자부품 모듈", "소프트웨어 모듈", "파이썬 모듈", "교육 모듈")
DIRECT = ("모듈러", "공업화주택", "OSC")
FACILITIES = ("병영생활관", "군간부숙소", "간부숙소", "숙소", "관사", "막사")
ORGANISATIONS = ("LH", "한국토지주택공사", "국방부", "교육청")
DEFENCE = ("국방시설본부", "육군", "해군", "공군", "국방부")
ACTIVE = ("공고중", "공고의뢰중", "계약대기중")
HOUSING_CONTEXT = ("기숙사", "학교", "임시교사", "군간부숙소", "병영생활관")
PUBLIC_BODIES = ("LH", "GH", "SH", "국방부", "교육청", "병영생활관", "군간부숙소")
COMPETITORS = ("유창이앤씨", "플랜엠", "금강공업", "엠쓰리시스템즈", "희림", "자이가이스트", "삼성물산", "현대건설", "DL이앤씨")
NEWS_PACKS = {
    "핵심 모듈러": ("모듈러 건축", "모듈러 주택", "OSC 건설", "공업화주택", "프리패브 건축", "프리팹 건축", "스마트건설 모듈러"),
    "공공·정책": ("LH 모듈러", "GH 모듈러", "SH 모듈러", "국방부 병영생활관", "군간부숙소 모듈러", "학교 모듈러", "임시교사 모듈러", "공공임대 모듈러"),
    "경쟁사·시장": (
        "유창이앤씨 모듈러", "플랜엠 모듈러", "금강공업 모듈러", "엠쓰리시스템즈 모듈러", "희림 모듈러", "자이가이스트 모듈러", "삼성물산 모듈러", "현대건설 모듈러", "DL이앤씨 모듈러",
    ),
}

# Stages of a notice (first match wins), stages that are open, and terms that titles drop.
NOTICE_STAGES = (
    ("result", ("우선협상대상자", "선정결과", "심사결과", "평가결과", "당선작", "계약체결")),
    ("update", ("질의답변", "일정변경", "자료수정", "추가자료", "추가 안내")),
    ("correction", ("정정공고", "수정공고")),
    ("re_notice", ("재공고", "재공모")),
    ("pre_notice", ("사전예고",)),
    ("main_notice", ("공모", "공고")),
)
OPEN_STAGES = ("pre_notice", "main_notice", "re_notice", "correction", "notice")
TITLE_DROPS = ("사전예고", "본공고", "재공고", "정정공고", "수정공고", "평가결과", "우선협상대상자", "선정결과", "심사결과", "당선작", "계약체결")
CONFIRMED = ("모듈러", "OSC", "Off-Site", "공업화주택", "프리패브", "PC 모듈러", "스틸 모듈러", "공장제작", "DfMA")
HOUSING_CONTESTS = ("민간참여 공공주택", "민간참여 공공주택건설사업", "민간참여 공공주택사업", "민간사업자 공모", "공공주택건설사업")

# Terms of candidate articles, each found as whole words, and their weights.
STRONG_TERMS = (
    "modular construction", "modular building", "modular housing", "modular home", "modular apartment", "prefabricated building",
    "prefabricated housing", "prefab building", "prefab construction", "prefabricated construction", "offsite construction",
    "off-site construction", "offsite manufacturing", "off-site manufacturing", "factory-built housing", "volumetric modular",
    "industrialized construction", "modular school", "modular classroom", "modular hospital", "modular hotel", "modular data center",
    "modular dormitory", "modular accommodation", "modular factory", "modular office building",
)
SUPPORTING_TERMS = (
    "steel modular", "timber modular", "concrete modular", "factory-built", "factory manufactured building", "manufactured building",
    "module manufacturing", "module assembly", "prefabrication", "mmc", "modern methods of construction", "industrialized construction",
    "panelized construction",
)
EXCLUSION_TERMS = (
    "software module", "software modularity", "modular synthesizer", "modular smartphone", "modular phone", "modular furniture",
    "modular sofa", "modular kitchen", "modular arithmetic", "mathematical modular", "nuclear reactor module", "gaming module",
    "electronic module", "battery module", "camera module", "memory module", "python module", "javascript module",
)
CONTEXT_WEIGHTS = {
    "construction": 10, "building": 10, "housing": 10, "residential": 8, "home": 5, "school": 10, "classroom": 5, "hospital": 10, "hotel": 10,
    "dormitory": 5, "apartment": 5, "factory": 5, "manufacturing": 10, "module": 5, "volumetric": 10, "contractor": 5, "office": 5,
    "accommodation": 5, "developer": 5, "architecture": 5, "project": 9, "facility": 5, "council": 5,
}
WEAK_TERMS = ("modular", "prefab", "prefabricated", "off site", "offsite")
# Reason -> (phrases that suffice, indicators, terms that must stand beside an indicator).
EXCLUSION_RULES = {
    "software_component": ((), ("software", "log4j", "digital flaw", "vulnerability", "cyber", "computer security", "programming"), ("modular component", "software module", "module")),
    "defense_modular_system": (
        ("modular open systems approach", "modular open system approach", "weapons system", "military aviation system"),
        ("army", "military", "defense", "future vertical lift", "adversaries", "forces"), ("modular", "open systems", "systems approach")),
    "offsite_venue_not_construction": ((), ("venue", "venues", "fashion", "event"), ("off site", "offsite")),
    "non_building_military_infrastructure": (("modular bridge", "assault bridge", "military bridge"), ("military", "army", "forces", "adversaries"), ("bridge", "modular")),
    "non_building_use_of_modular": ((), ("electronics", "electronic", "computer architecture", "smartphone", "battery", "camera", "memory"), ("modular", "module")),
}
# Weights of terms.
STRONG_WEIGHT, SUPPORTING_WEIGHT, EXCLUSION_WEIGHT, NOISE_WEIGHT, WEAK_WEIGHT = 70, 18, -80, -20, 40
PUBLISH_AT, REVIEW_AT = 80, 50
