"""Settings of the three runs, with their command lines."""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass

#: The domains of the benchmark.
DOMAINS = ("biology", "earth_science", "economics", "pony", "psychology", "robotics", "stackoverflow", "sustainable_living")


@dataclass(frozen=True)
class RankingRun:
    """Scoring of a pool per query under several reading plans. queries 0: all; pool_size 0: the whole corpus, nothing injected."""

    domain: str = "ALL"
    model: str = "Qwen/Qwen3-4B-Instruct-2507"
    cache_dir: str = "./cache_dir"
    queries: int = 10
    pool_size: int = 100
    modes: tuple[str, ...] = ("naive", "rows", "grid", "firstp")
    chunk_size: int = 100
    max_model_len: int = 8192
    max_num_seqs: int = 256
    gpu_mem: float = 0.90
    gen_batch: int = 512
    server: str = ""
    outdir: str = "runs"
    overwrite: bool = False
    seed: int = 42

    @property
    def domains(self) -> tuple[str, ...]:
        return DOMAINS if self.domain == "ALL" else (self.domain,)

    @property
    def model_name(self) -> str:
        return self.model.rsplit("/", 1)[-1]

    @property
    def protocol(self) -> str:
        return "full-corpus" if self.pool_size <= 0 else f"pooled{self.pool_size}+goldinjected"

    @property
    def table_name(self) -> str:
        return f"table_{self.domain}_{self.model_name}_{self.max_model_len}_p{self.pool_size}"

    def key(self, domain: str, mode: str) -> str:
        """What a stored score depends on: scores of another key are never taken for these."""
        return f"{domain}_{mode}_{self.model_name}_{self.max_model_len}_p{self.pool_size}_c{self.chunk_size}_s{self.seed}"


@dataclass(frozen=True)
class ScalingRun:
    """Cost of whole reading against the grid over documents of all lengths. max_naive_tokens None: no guard."""

    domain: str = "biology"
    model: str = "Qwen/Qwen3.5-9B"
    queries: int = 1
    docs_per_query: int = 50
    golds_per_query: int = 2
    chunk_words: int = 100
    max_naive_tokens: int | None = 32_000
    outdir: str = "runs_scaling"
    seed: int = 42


@dataclass(frozen=True)
class LocalizationRun:
    predictions: str = "predictions.csv"
    ground_truth: str = "ground_truth.xlsx"
    out_excel: str = "localization.xlsx"
    out_csv: str = "localization.csv"


def parsed(kind, argv: list[str] | None = None):
    """A run of this kind from a command line: --name value for each field, underscores as hyphens or as they are, lists with commas."""
    p = argparse.ArgumentParser(description=kind.__doc__)
    for f in dataclasses.fields(kind):
        names = list(dict.fromkeys((f"--{f.name.replace('_', '-')}", f"--{f.name}")))
        if isinstance(f.default, bool):
            p.add_argument(*names, action="store_true", default=f.default)
        elif isinstance(f.default, tuple):
            p.add_argument(*names, type=lambda s: tuple(s.split(",")), default=f.default)
        else:
            p.add_argument(*names, type=int if f.name == "max_naive_tokens" else type(f.default), default=f.default, **({"choices": (*DOMAINS, "ALL")} if f.name == "domain" else {}))
    return kind(**vars(p.parse_args(argv)))
