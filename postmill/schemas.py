"""Explicit schemas; nothing is inferred.

Tables are ``{column: type}``; ``ddl`` turns one into the text Spark's readers take.
"""

from __future__ import annotations


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


_CONTENT = {
    "title": "string", "company": "string", "location": "string", "remote": "boolean",
    "url": "string", "description": "string", "tags": "array<string>", "posted_at": "timestamp",
    "salary_min": "double", "salary_max": "double", "salary_currency": "string",
    "salary_period": "string", "salary_is_predicted": "boolean",
}
#: Columns an upsert overwrites.
CONTENT = tuple(_CONTENT)
#: One posting as fetched.
BATCH = {"source": "string", "external_id": "string", **_CONTENT}
#: One stored posting.
POSTING = {
    "id": "bigint", **BATCH, "first_seen_at": "timestamp", "last_seen_at": "timestamp",
    "status": "string", "missed_run_count": "int", "embedding_queued_at": "timestamp",
}
APPLICATION = {
    "id": "bigint", "vacancy_id": "bigint", "status": "string", "notes": "string",
    "follow_up_at": "date", "created_at": "timestamp", "updated_at": "timestamp",
}
APPLICATION_EVENT = {
    "id": "bigint", "application_id": "bigint", "status": "string", "note": "string",
    "created_at": "timestamp",
}
ARTIFACT = {
    "id": "bigint", "vacancy_id": "bigint", "artifact_type": "string", "content": "string",
    "vacancy_title": "string", "vacancy_company": "string", "vacancy_url": "string",
    "created_at": "timestamp",
}


def _profile(date: str) -> dict[str, str]:
    span = f"start_date:{date},end_date:{date}"
    return {
        "full_name": "string", "location": "string", "email": "string", "phone": "string",
        "linkedin_url": "string", "github_url": "string", "summary": "string",
        "languages": "string",
        "skills": "array<struct<name:string,category:string>>",
        "experiences": "array<struct<title:string,company:string,location:string,"
                       f"{span},highlights:string>>",
        "educations": f"array<struct<institution:string,degree:string,field:string,{span}>>",
    }


#: The profile file: dates are still ISO text.
PROFILE_FILE = _profile("string")
PROFILE = {"id": "bigint", **_profile("date")}
#: One row of the stored index.
INDEX = {
    "vacancy_id": "bigint", "source": "string", "title": "string", "company": "string",
    "url": "string", "embedding": "array<float>", "status": "string",
}
CHANGE = {"vacancy_id": "bigint", "published_at": "timestamp"}

#: Landed payloads.
JSON_PAGE = {
    "results": "array<struct<id:string,title:string,company:struct<display_name:string>,"
               "location:struct<display_name:string>,redirect_url:string,description:string,"
               "category:struct<label:string>,created:string,salary_min:double,"
               "salary_max:double,salary_is_predicted:string>>",
}
JSON_TAGGED_PAGE = {
    "data": "array<struct<slug:string,company_name:string,title:string,description:string,"
            "remote:boolean,url:string,tags:array<string>,job_types:array<string>,"
            "location:string,created_at:bigint>>",
    "links": "struct<next:string>",
}
RSS_ITEM = {
    "title": "string", "link": "string", "description": "string", "pubDate": "string",
    "guid": "string",
}
SITEMAP_ENTRY = {"loc": "string"}
