"""Record types of the listing pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _strings(names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names.split(), _S)


LISTING = _struct(
    **_strings("_id id title img url companyUrl date postedDate company location countryCode countryText descriptionHtml descriptionText city"),
    remoteOk=_B, salaryMin=_D, salaryMax=_D, salaryCurrency=_S, stackRequired=T.ArrayType(_S),
    **_strings("applicants seniorityLevel employmentType jobFunction industries salaryRange postedTime"),
)
HIT = _struct(**_strings("id title company location url descriptionHtml"))
DETAIL = _struct(**_strings("url title company location postedTime applicants salaryRange seniorityLevel employmentType jobFunction industries descriptionText remoteBox"))
REGISTRY = _struct(listingId=_S, company=_S, title=_S, admitTime=_L, lastProcessed=_L)
