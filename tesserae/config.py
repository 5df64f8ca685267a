"""Defaults of retrieval and comparison."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1800
    chunk_overlap: int = 200
    separators: tuple[str, ...] = ("\n## ", "\n### ", "\n- ", "\n\n", "\n", ". ", " ")
    dense_k: int = 10
    bm25_k: int = 8
    summary_dense_k: int = 4
    summary_bm25_k: int = 4
    fused: int = 10
    reranked: int = 6
    context_chars: int = 16_000
    date_context_chars: int = 12_000
    neighbours: int = 1
    variants: int = 4
    subquestions: int = 3
    boosted_sections: int = 3
    rrf_k: int = 60
    hint_rrf_k: int = 50
    summary_chars: int = 800
    answer_mode: str = "Подробно"
    default_folder: str = "Без папки"
    all_folders: str = "Все папки"
    upload_types: tuple[str, ...] = ("pdf", "docx", "md", "txt")
    upload_bytes: int = 100 << 20


DEFAULT = Config()
