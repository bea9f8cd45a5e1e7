"""Which raw column is which concept: from headers, then checked on a bounded sample of values.

The header variants of a concept: those of the usual exports, its label, some
others, and what follows from a rule: its English name with the usual short and
long forms of its words. More can be given for each concept.
"""

from __future__ import annotations

import difflib
import re
from itertools import islice, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import THRESHOLDS
from ..functions import parse as P

# Concepts and their labels.
LABELS = {
    "pub_number": "공개번호", "app_number": "출원번호", "reg_number": "등록번호", "family_id": "패밀리 ID", "family_rep": "패밀리 대표문헌", "title": "발명의 명칭", "abstract": "요약",
    "indep_claim": "독립청구항", "claims": "전체 청구항", "applicant": "출원인", "applicant_std": "표준화 출원인", "assignee": "현재 권리자", "inventors": "발명자", "app_date": "출원일",
    "pub_date": "공개일", "reg_date": "등록일", "priority_date": "우선일", "expiry_date": "만료예정일", "country": "국가", "legal_status": "법적상태", "is_granted": "등록 여부", "is_active": "존속 여부",
    "cites_backward": "인용 수", "cites_forward": "피인용 수", "family_size": "패밀리 수", "family_country_count": "패밀리 국가 수", "family_countries": "패밀리 국가 목록",
    "tech_l1": "기술 대분류", "tech_l2": "기술 중분류", "tech_l3": "기술 소분류", "tech_b_l1": "B축 대분류", "tech_b_l2": "B축 중분류", "tech_b_l3": "B축 소분류",
    "tech_c_l1": "C축 대분류", "tech_c_l2": "C축 중분류", "tech_c_l3": "C축 소분류", "tech_multi": "다중 기술분류", "class_confidence": "분류 신뢰도", "problem": "해결과제", "solution": "해결수단",
    "product": "제품", "process": "공정", "material": "소재", "structure": "구조", "effect": "효과", "claims_count": "청구항 수", "indep_claims_count": "독립항 수", "ipc": "IPC/CPC 분류",
    "embedding": "임베딩 벡터", "is_own": "자사 특허 여부", "lapse_date": "소멸일", "agent": "대리인", "expedited_exam": "우선심사 여부", "exam_request_date": "심사청구일", "license_flag": "실시권 설정 유무",
    "licensee_count": "실시권자 수", "sep_org": "표준화기구", "sep_number": "표준번호", "sep_date": "표준 선언일", "rejection_reason": "거절 사유", "rejection_flag": "거절결정 여부", "reexam_flag": "재심사청구 여부",
    "npl_count": "비특허 참고문헌 수", "recent_assignee": "최근 양수인", "recent_assignor": "최근 양도인", "assign_date": "최근 양도일", "assign_type": "최근 양도유형", "examiner": "심사관",
    "oa_count": "거절이유통지(OA) 횟수", "examiner_citations": "심사관 인용문헌 수", "applicant_citations": "출원인측 인용문헌 수", "parent_app_number": "원출원번호", "drawings_count": "도면 수",
    "spec_length": "명세서 분량", "trial_info": "심판 이력", "trial_claimant": "심판 청구인", "trial_count": "심판 전체 횟수", "lawsuit_count": "소송 전체 횟수", "court_type": "관할 법원 종류",
    "gov_program": "국가연구 과제명", "cites_backward_nums": "인용 문헌번호 목록", "cites_forward_self": "자기 피인용 문헌번호", "cites_forward_other": "타인 피인용 문헌번호", "first_filing_country": "최우선출원국가",
    "exam_request_flag": "심사청구 여부", "divisional_flag": "분할출원 여부", "epc_valid_states": "EPC 유효국", "epc_lapsed_states": "EPC 소멸국", "annuity_date": "최근 연차료일", "ai_summary": "AI 요약",
    "feature_summary": "특징 요약", "detail_link": "상세보기 링크",
}
# The kinds of concepts that aren't text.
KINDS = {
    "date": ["app_date", "pub_date", "reg_date", "priority_date", "expiry_date", "lapse_date", "exam_request_date", "sep_date", "assign_date", "annuity_date"],
    "number": ["cites_backward", "cites_forward", "family_size", "family_country_count", "class_confidence", "claims_count", "indep_claims_count", "oa_count", "drawings_count", "spec_length", "trial_count", "lawsuit_count", "licensee_count", "npl_count"],
    "bool": ["is_granted", "is_active", "is_own", "expedited_exam", "license_flag", "rejection_flag", "reexam_flag", "exam_request_flag", "divisional_flag"],
    "country": ["country", "first_filing_country"],
    "count_or_list": ["examiner_citations", "applicant_citations", "cites_forward_self", "cites_forward_other"],
}
# Other forms of the words that concept names are made of.
FORMS = {
    "pub": ["publication"], "app": ["application", "filing", "appl"], "reg": ["registration", "grant"], "number": ["no", "num"], "id": ["no", "number"], "rep": ["representative"], "indep": ["independent"],
    "std": ["standardized", "normalized"], "l1": ["level 1", "large"], "l2": ["level 2", "medium"], "l3": ["level 3", "small"], "tech": ["technology"], "cites": ["citations"], "nums": ["numbers"], "count": ["cnt"],
    "inventors": ["inventor"], "abstract": ["summary"], "title": ["invention title"], "claims": ["claim"], "assignee": ["current assignee", "owner"], "ipc": ["cpc", "ipc code"], "expiry": ["expiration"],
}
# The headers that stand for a concept in the usual exports; they go before its other names.
PREFERRED = {
    "family_id": ["WIPS패밀리 ID"], "family_rep": ["WIPS패밀리 Basic Patent 문헌번호"], "indep_claim": ["독립청구항[KR,JP,US,CN,EP,IN]"], "applicant_std": ["출원인 대표명화 국문명"],
    "assignee": ["현재권리자 대표명화 국문명", "현재권리자"], "priority_date": ["최우선출원일"], "expiry_date": ["존속기간(예상)만료일[KR,JP,US,EP,CN,CA,AU]", "존속기간(예상)만료일"],
    "legal_status": ["상태정보[KR,JP,US,EP,CN,CA,AU]"], "cites_backward": ["인용 문헌 수(B1)", "인용 문헌수", "인용 문헌 수"], "cites_forward": ["피인용 문헌 수(F1)", "피인용 문헌수", "피인용 문헌 수"],
    "family_size": ["WIPS패밀리 문헌 수(출원기준)"], "family_country_count": ["WIPS패밀리 국가 수(출원기준)"], "family_countries": ["WIPS패밀리 개별국 문헌 수(출원기준)"],
    "problem": ["해결과제 요약"], "solution": ["해결수단 요약"], "effect": ["효과 요약"], "ipc": ["Current IPC All"], "expedited_exam": ["우선심사청구 여부"], "license_flag": ["실시권 설정 유무"],
    "licensee_count": ["실시권자 수"], "rejection_reason": ["거절 사유"], "npl_count": ["비 특허 참고문헌 수(B1)"], "recent_assignee": ["최근 양수인"], "recent_assignor": ["최근 양도인"],
    "assign_date": ["최근 양도일"], "assign_type": ["최근 양도유형"], "examiner": ["심사관"], "oa_count": ["거절서류발행 횟수[KR]"], "examiner_citations": ["심사관인용 문헌번호"],
    "applicant_citations": ["자기인용 문헌번호"], "drawings_count": ["개별도면 수"], "cites_backward_nums": ["인용 문헌번호(B1)"], "cites_forward_self": ["자기 피인용 문헌번호(F1)"],
    "cites_forward_other": ["타인 피인용 문헌번호(F1)"], "first_filing_country": ["최우선출원국가"], "exam_request_flag": ["심사청구 여부"], "divisional_flag": ["분할출원 여부"],
    "epc_valid_states": ["EPC유효국"], "epc_lapsed_states": ["EPC소멸국"], "annuity_date": ["최근 연차료일"], "ai_summary": ["AI 요약"], "feature_summary": ["특징 요약"],
    "detail_link": ["상세보기 링크(비로그인)"],
}
# Other headers that no rule gives.
OTHERS = {
    "title": ["명칭", "제목"], "abstract": ["초록"], "indep_claim": ["대표청구항", "청구항 1"], "claims": ["청구항", "청구범위"], "applicant_std": ["대표 출원인", "출원인 그룹"], "assignee": ["권리자", "양수인"],
    "priority_date": ["우선권 주장일", "우선권주장일", "최우선일"], "expiry_date": ["만료일", "존속기간 만료일"], "country": ["국가코드", "출원국", "발행국"], "legal_status": ["상태정보", "행정상태", "현재상태"],
    "is_active": ["유효 여부", "권리존속여부"], "family_countries": ["지정국"], "family_country_count": ["지정국 수", "출원국 수"], "tech_l1": ["대분류"], "tech_l2": ["중분류"], "tech_l3": ["소분류"],
    "tech_multi": ["다중분류", "복수분류"], "class_confidence": ["신뢰도"], "problem": ["과제"], "solution": ["수단"], "product": ["적용제품"], "process": ["제조공정"], "material": ["재료"], "ipc": ["국제특허분류", "Current CPC All"],
    "expedited_exam": ["우선심사 여부", "우선심사"], "sep_date": ["선언일"], "oa_count": ["거절서류발행 횟수", "OA 횟수"], "examiner_citations": ["심사관 인용"], "applicant_citations": ["출원인 인용"],
    "parent_app_number": ["모출원번호"], "drawings_count": ["도면수"], "trial_info": ["심판 종류", "심판 정보"], "trial_count": ["심판 횟수", "심판 건수"], "lawsuit_count": ["소송 횟수", "소송 건수"],
    "gov_program": ["국책과제명", "정부과제명"], "cites_backward_nums": ["인용 문헌번호"], "npl_count": ["비특허 참고문헌 수"],
}
_SPECIAL = re.compile(r"[\s()\[\]{}\-_/\\.,:;'\"·|]+")
CITING = ("인용", "citation", "cited", "citing", "reference")
FAMILY = ("패밀리", "family", "국가", "개별국", "지정국")
#: Concepts that a loose match needs one of these words for.
GUARDS = dict.fromkeys(["cites_backward", "cites_forward", "examiner_citations", "applicant_citations", "cites_backward_nums", "cites_forward_self", "cites_forward_other"], CITING) | dict.fromkeys(["family_size", "family_country_count", "family_countries", "family_id"], FAMILY)


def kind_of(concept: str) -> str:
    return next((k for k, names in KINDS.items() if concept in names), "text")


def normal(header: object) -> str:
    return _SPECIAL.sub("", str(header or "").strip().lower())


def bare(header: object) -> str:
    """Without a [country list] and a code in brackets at the end."""
    return re.sub(r"\(\s*[A-Za-z0-9,\s]+\s*\)\s*$", "", re.sub(r"\[[^\]]*\]", "", str(header)).strip()).strip()


def header_kind(n: str) -> str:
    if n.endswith(("수", "count", "cnt", "숫자")) or any(x in n for x in ("건수", "횟수", "countof")):
        return "number"
    if "번호" in n or "number" in n or n.endswith("no"):
        return "text"
    return "date" if any(x in n for x in ("일자", "date", "년월일")) or n.endswith("일") else "text"


def variants(concept: str, more: dict[str, list[str]] | None = None) -> list[str]:
    words = concept.split("_")
    names = [" ".join(p) for p in islice(product(*[[w, *FORMS.get(w, [])] for w in words]), 64)]
    return [*PREFERRED.get(concept, []), LABELS[concept], *OTHERS.get(concept, []), *names, *(more or {}).get(concept, [])]


def _fits(concept: str, header: str) -> bool:
    k, h = kind_of(concept), header_kind(header)
    return {"date": h == "date", "number": h == "number", "count_or_list": h in ("number", "text")}.get(k, h == "text")


def _match(concept: str, column: str, names: list[str], cutoff: float) -> tuple[float, str] | None:
    first = [normal(v) for v in PREFERRED.get(concept, [])]
    whole, short = normal(column), normal(bare(column))
    forms = [whole, short] if short and short != whole else [whole]
    for i, form in enumerate(forms):
        if form in names:
            return (1.01 if form in first else 0.99 if i else 1.0), "exact"
    text = short + whole
    if not _fits(concept, short or whole) or concept in GUARDS and not any(w in text for w in GUARDS[concept]):
        return None
    part = [0.8 + 0.1 * min(len(n), len(f)) / max(len(n), len(f)) for f in forms for n in names if len(n) >= 2 and (n in f or f in n)]
    if part:
        return round(max(part), 3), "partial"
    ratio = max(difflib.SequenceMatcher(None, f, n).ratio() for f in forms for n in names)
    return (round(ratio, 3), "fuzzy") if ratio >= cutoff else None


def suggest_mapping(columns: list[str], cutoff: float | None = None, more: dict[str, list[str]] | None = None) -> dict[str, dict]:
    """{concept: {column, method, score}}: best matches first, each column and each concept once."""
    cut = THRESHOLDS["fuzzy_match_cutoff"] if cutoff is None else cutoff
    found = []
    for concept in LABELS:
        names = [normal(v) for v in variants(concept, more)]
        found += [(-m[0], concept, c, m[1]) for c in columns if normal(c) and (m := _match(concept, c, names, cut))]
    out: dict[str, dict] = {}
    used: set[str] = set()
    for score, concept, column, method in sorted(found):
        if concept not in out and column not in used:
            out[concept] = {"column": column, "method": method, "score": -score}
            used.add(column)
    return out


def validate_mapping(df: DataFrame, mapping: dict[str, dict], rows: int = 300) -> dict[str, dict]:
    """The mapping without columns whose values don't look like their concept: one aggregation over a bounded sample.

    Dates need 3 of 10 values that parse, numbers, counts and countries half; text is refused if 7 of 10 are numbers or dates.
    """
    checks = []
    for concept, m in mapping.items():
        c = F.col(f"`{m['column']}`").cast("string")
        said, k = P.present(c), kind_of(concept)
        tests = {
            "date": lambda c: P.parse_date(c).isNotNull(), "number": lambda c: P.parse_numeric(c).isNotNull(), "count_or_list": lambda c: P.parse_numeric(c).isNotNull() | (F.size(P.parse_multi(c)) > 0), "country": lambda c: F.length(F.trim(c)) <= 8,
            "text": lambda c: F.trim(c).rlike(r"^[+-]?[\d,]+(\.\d+)?$") | P.parse_date(c).isNotNull(),
        }
        if k in tests and not concept.endswith(("number", "_id", "_rep", "embedding")):
            checks.append(F.coalesce(F.try_divide(F.sum((said & tests[k](c)).cast("int")), F.sum(said.cast("int"))), F.lit(-1.0)).alias(concept))
    if not checks:
        return dict(mapping)
    share = df.limit(rows).agg(*checks).first().asDict()
    least = {"date": 0.3, "number": 0.5, "count_or_list": 0.5, "country": 0.5}
    bad = {c for c, s in share.items() if s >= 0 and (s >= 0.7 if kind_of(c) == "text" else s < least[kind_of(c)])}
    return {c: m for c, m in mapping.items() if c not in bad}


def clean_mapping(mapping: dict[str, str], columns: list[str]) -> dict[str, str]:
    """Saved choices bound to the columns of today: the same name, or the only one with the same normalised name. A column serves one concept."""
    by: dict[str, list[str]] = {}
    for c in columns:
        by.setdefault(normal(c), []).append(c)
    out: dict[str, str] = {}
    for concept, c in mapping.items():
        found = c if c in columns else (by.get(normal(c), [None])[0] if len(by.get(normal(c), [])) == 1 else None)
        if concept in LABELS and found and found not in out.values():
            out[concept] = found
    return out


_TECH, _DATE, _WHO = ("tech_l1", "tech_l2", "tech_l3", "tech_multi", "ipc"), ("app_date", "priority_date", "pub_date"), ("applicant", "applicant_std")
_TEXT = ("ai_summary", "abstract", "indep_claim", "title")
#: What an analysis needs: all of its entries, one of each tuple.
REQUIRED: dict[str, list] = {
    "overview": [_TECH, _DATE], "technology-network": [_TECH], "emerging-combinations": [_TECH, _DATE], "lifecycle": [_TECH, _DATE], "opportunity": [_TECH, _DATE], "problem-solution": [("tech_c_l1", "tech_c_l2", "tech_c_l3"), ("tech_b_l1", "tech_b_l2", "tech_b_l3")],
    "technology-transition": [_TECH, _DATE], "trajectory": [_TECH, _DATE, _WHO], "company-dna": [_TECH, _DATE, _WHO], "lead-lag": [_TECH, _DATE, _WHO], "claim-density": ["indep_claim", _TECH], "citation-diffusion": ["cites_forward", _TECH], "inventor-mobility": ["inventors", _WHO, _DATE],
    "classification-quality": [_TECH], "basic-stats": [_DATE], "advanced-stats": [_WHO], "portfolio-index": [_WHO, "cites_forward"], "scope-entropy": [_TECH, _WHO], "combo-upset": [_TECH], "emerging-clusters": [_TEXT, _DATE], "semantic-influence": [_TEXT, _DATE], "similarity-network": [_TEXT],
    "procedure-deep": [_DATE], "exec-plus": [_DATE, _WHO], "executive-summary": [_TECH, _DATE, _WHO], "axis-cross": [_TECH], "tech-year-bubble": [_TECH, _DATE], "company-focus": [_TECH, _DATE, _WHO], "tech-tree": [_TECH], "deep-plus": [(*_WHO, "pub_number", "app_number")], "ownership": [_WHO, "assignee"],
}


def availability(mapped: set[str]) -> dict[str, list[str]]:
    """What each analysis lacks; nothing: it can run."""
    return {a: [r if isinstance(r, str) else " | ".join(r) for r in need if not ({r} if isinstance(r, str) else set(r)) & mapped] for a, need in REQUIRED.items()}
