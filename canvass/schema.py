"""Spark types of the data model.

A response is one row with an array of answer slots; the long slot table is its explode.
Keeping the slots of one response in one row makes path resolution, state completion and
conditional shares narrow operations.
"""

from __future__ import annotations

ANSWERED, SKIPPED, NOT_REACHED, INDETERMINATE = "answered", "skipped", "not_reached", "indeterminate"
ELIGIBLE_STATES = (ANSWERED, SKIPPED)
STATES = (ANSWERED, SKIPPED, NOT_REACHED, INDETERMINATE)

SLOT_DDL = (
    "struct<question_id:string,kind:string,state:string,option_key:string,label:string,"
    "other_value:string,option_keys:array<string>,labels:array<string>,score:int,text:string,"
    "files:array<struct<file_name:string,mime_type:string>>,values:array<string>>"
)
SLOT_FIELDS = (
    "question_id", "kind", "state", "option_key", "label", "other_value",
    "option_keys", "labels", "score", "text", "files", "values",
)

# Landed response document: answers keyed by question id.
RESPONSE_JSON = (
    "struct<responseId:string,createTime:string,lastSubmittedTime:string,"
    "answers:map<string,struct<"
    "textAnswers:struct<answers:array<struct<value:string>>>,"
    "fileUploadAnswers:struct<answers:array<struct<fileId:string,fileName:string,mimeType:string>>>>>>"
)

_CHOICE = (
    "struct<type:string,shuffle:boolean,"
    "options:array<struct<value:string,isOther:boolean,goToAction:string,goToSectionId:string>>>"
)
_QUESTION = (
    "struct<questionId:string,required:boolean,"
    f"choiceQuestion:{_CHOICE},"
    "textQuestion:struct<paragraph:boolean>,"
    "scaleQuestion:struct<low:int,high:int,lowLabel:string,highLabel:string>,"
    "dateQuestion:struct<includeTime:boolean,includeYear:boolean>,"
    "timeQuestion:struct<duration:boolean>,"
    "fileUploadQuestion:struct<types:array<string>,maxFiles:int,maxFileSize:string>,"
    "ratingQuestion:struct<ratingScaleLevel:int,iconType:string>,"
    "rowQuestion:struct<title:string>>"
)

# Landed form document: an ordered list of items.
FORM_JSON = (
    "struct<formId:string,info:struct<title:string,description:string>,"
    "items:array<struct<itemId:string,title:string,description:string,"
    "pageBreakItem:struct<_:string>,"
    f"questionItem:struct<question:{_QUESTION}>,"
    f"questionGroupItem:struct<questions:array<{_QUESTION}>,"
    f"grid:struct<columns:{_CHOICE},shuffleQuestions:boolean>>>>>"
)
