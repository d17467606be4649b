"""The four stored tables and the risk result, handed around as one value."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvegrid.operators.risk import RiskSnapshot, risk_of, risk_scores

# The relation names existing queries are written against.
VIEW_NAMES = {
    "kev": "kev_vulnerabilities",
    "nvd": "nvd_vulnerabilities",
    "epss": "epss_scores",
    "cwe": "cwe_definitions",
    "risk": "v_cve_risk",
}


@dataclass(frozen=True)
class Catalog:
    """Lazy handles on the tables; ``snapshot`` is the stored risk result when there is one."""

    kev: DataFrame
    nvd: DataFrame
    epss: DataFrame
    cwe: DataFrame | None = None
    snapshot: RiskSnapshot | None = None

    @cached_property
    def risk(self) -> DataFrame:
        if self.snapshot is not None:
            return self.snapshot.read()
        return risk_scores(self.nvd, self.kev, self.epss)

    def risk_of(self, ids: DataFrame) -> DataFrame:
        """Risk rows of the requested ids, without blending or reading the others."""
        if self.snapshot is not None:
            return self.snapshot.look_up(ids)
        return risk_of(self.nvd, self.kev, self.epss, ids)

    def riskiest(self, limit: int) -> DataFrame:
        """The risk rows with the highest scores."""
        if self.snapshot is not None:
            return self.snapshot.top(limit)
        return self.risk.orderBy(F.col("risk_score").desc(), "cve_id").limit(limit)

    def with_snapshot(self, snapshot: RiskSnapshot) -> Catalog:
        return replace(self, snapshot=snapshot)

    def register_views(self) -> None:
        """Expose the tables to SQL text under the names existing queries use."""
        for field, view in VIEW_NAMES.items():
            frame = getattr(self, field)
            if frame is not None:
                frame.createOrReplaceTempView(view)
