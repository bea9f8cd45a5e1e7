"""A source of made-up filings as untidy text, for tests: rows that depend on the seed and their own number alone, whatever the partitioning."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Columns that a caller may do without.
OPTIONAL = ["피인용 수", "인용 수", "패밀리 수", "임베딩 벡터", "분류 신뢰도", "대리인", "만료일", "원출원번호", "심판 이력", "국가연구 과제명"]
COLUMNS = [
    "공개번호", "출원번호", "등록번호", "패밀리 ID", "발명의 명칭", "요약", "독립청구항", "출원인", "현재 권리자", "발명자", "출원일", "등록일", "우선일", "만료일", "국가", "법적상태", "등록 여부",
    "인용 수", "피인용 수", "패밀리 수", "기술 대분류", "기술 중분류", "다중 기술분류", "분류 신뢰도", "청구항 수", "IPC/CPC 분류", "해결과제", "해결수단", "임베딩 벡터", "대리인", "원출원번호", "심판 이력", "국가연구 과제명",
]
AREAS = {"bonding": ["hybrid bonding", "wire bonding", "flip chip", "die attach"], "molding": ["film molding", "liquid molding", "underfill"], "wiring": ["fine wiring", "via", "redistribution", "interposer"], "heat": ["heat sink", "thermal film", "cooling", "vapour chamber"]}
COMPANIES = ["Aster", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gorse", "Hazel", "Ivy", "Juniper"]
STATES = ["등록", "등록", "존속기간만료", "공개", "심사중", "거절", "취하"]
DIMS = 8

#: The twelve shapes that a loader has to take, by what differs from the first.
VARIANTS: dict[str, dict[str, str]] = {
    "all columns": {}, "optional columns missing": {"without": ";".join(OPTIONAL)}, "other separators": {"sep": "|"}, "classes as json": {"classes": "json"},
    "a class of one": {"single": "lonely class"}, "no recent years": {"quiet": "3"}, "repeated families": {"family": "5"}, "spellings of names": {"spellings": "1"},
    "states missing": {"stateless": "30"}, "no citations": {"without": "피인용 수;인용 수"}, "no vectors": {"without": "임베딩 벡터"}, "many rows": {"rows": "50000", "seed": "99"},
}


def row(i: int, seed: int, o: dict[str, str]) -> dict[str, str | None]:
    """Row number ``i``, as text."""
    r = random.Random(f"{seed}:{i}")
    sep = o.get("sep", "; ")
    first, last = int(o.get("first", 2012)), int(o.get("last", 2024)) - int(o.get("quiet", 0))
    year = first + r.randrange(last - first + 1)
    area = r.choice([*AREAS])
    classes = [r.choice(AREAS[area])] + ([r.choice(AREAS[r.choice([*AREAS])])] if r.random() < 0.45 else [])
    if o.get("single") and i == 0:
        classes = [o["single"]]
    granted = r.random() < 0.55
    names = [r.choice(COMPANIES)] + ([r.choice(COMPANIES)] if r.random() < 0.12 else [])
    if o.get("spellings"):
        names = [r.choice([n, f"{n} Co., Ltd.", f"(주){n}", n.upper(), f"{n} Corp."]) for n in names]
    title = r.choice([f"{classes[0]} 방법", f"{classes[0]} 방법", f"A method of {classes[0]}", f"{classes[0]}の方法"])
    centre = [*AREAS].index(area)
    return {
        "공개번호": f"KR10-{year}-{i:07d}A", "출원번호": f"KR10-{year}-{i:07d}", "등록번호": f"KR10-{i:07d}" if granted else "", "패밀리 ID": f"FAM{i // int(o.get('family', 2)):05d}",
        "발명의 명칭": title, "요약": f"{area}의 {classes[0]}을 개선하는 구조", "독립청구항": f"{area}에서 {classes[0]}을 포함하는 {r.choice(['방법', '장치', '조성물'])}", "출원인": sep.join(names), "현재 권리자": r.choice(COMPANIES) if r.random() < 0.06 else names[0],
        "발명자": sep.join(r.sample([f"{names[0]} {k}" for k in "ABCDE"], 1 + r.randrange(3))), "출원일": f"{year}-{1 + r.randrange(12):02d}-15", "등록일": f"{year + 2}-{1 + r.randrange(12):02d}-20" if granted else "", "우선일": f"{year}-01-01", "만료일": f"{year + 20}-12-14",
        "국가": ["KR", "US", "JP", "CN", "EP"][i % 5], "법적상태": "" if r.random() * 100 < int(o.get("stateless", 0)) else r.choice(STATES), "등록 여부": "Y" if granted else "N",
        "인용 수": str(r.randrange(9)), "피인용 수": str(r.randrange(7) + 10 * (i % 37 == 0)), "패밀리 수": str(1 + r.randrange(8)), "기술 대분류": area, "기술 중분류": classes[0], "다중 기술분류": json.dumps(classes) if o.get("classes") == "json" else sep.join(classes),
        "분류 신뢰도": f"{0.3 + 0.7 * r.random():.3f}", "청구항 수": str(3 + r.randrange(32)), "IPC/CPC 분류": sep.join(r.sample(["H01L 23/28", "H01L 25/065", "H05K 1/18", "C08L 63/00"], 1 + r.randrange(3))),
        "해결과제": f"본 발명은 {r.choice(['휨', '방열', '박리'])} 문제를 해결하는 것이다", "해결수단": r.choice(["필름", "충전재", "범프"]), "임베딩 벡터": json.dumps([round(float(k == centre) + r.gauss(0, 0.25), 4) for k in range(DIMS)]),
        "대리인": r.choice(["P&K", "Lee", ""]), "원출원번호": f"KR10-{year - 1}-{r.randrange(10**6):07d}" if r.random() < 0.08 else "", "심판 이력": "무효심판" if r.random() < 0.05 else "", "국가연구 과제명": "N-1" if r.random() < 0.15 else "",
    }


class Filings(DataSource):
    """Format ``filings``; options: rows, seed, partitions, and those of VARIANTS."""

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        gone = set(self.options.get("without", "").split(";"))
        return ", ".join(f"`{c}` string" for c in COLUMNS if c not in gone)

    def reader(self, schema: Any) -> FilingsReader:
        return FilingsReader(schema.fieldNames(), dict(self.options))


class FilingsReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]) -> None:
        self.columns, self.options = columns, options
        self.rows, self.seed, self.parts = (int(options.get(k, v)) for k, v in (("rows", 600), ("seed", 42), ("partitions", 4)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((self.rows * k // self.parts, self.rows * (k + 1) // self.parts)) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        start, stop = partition.value
        for at in range(start, stop, 1000):
            rows = [row(i, self.seed, self.options) for i in range(at, min(stop, at + 1000))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in self.columns], self.columns)


def filings(spark: SparkSession, variant: str = "all columns", **options: Any) -> DataFrame:
    """A variant's rows, ``options`` over its own."""
    spark.dataSource.register(Filings)
    return spark.read.format("filings").options(**VARIANTS[variant], **{k: str(v) for k, v in options.items()}).load()
