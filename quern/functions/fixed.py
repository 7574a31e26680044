"""Texts that answers, prompts and the classifier of answers agree on."""

EMPTY_STORE = "知识库为空。请先建立索引。"
NOT_FOUND_HEAD = "资料中未找到与该问题相关的内容（最高置信度 "
NOT_FOUND_TAIL = "）。建议换个说法或检查文档是否已索引。"
UNCONFIRMED = "资料中无法确认该问题的具体答案。为避免编造信息，本次不生成推测性回答。"
NO_HISTORY = "(无历史)"
USER_LINE, ASSISTANT_LINE = "用户: ", "助手: "
CONFIDENCE_MARK = "置信度: "
NO_CONTEXT = "[无上下文]"
CONTEXT_OPEN, CONTEXT_CLOSE = "【", "】\n\n"
IMAGE_CAPTION = "[图片描述] "

# What models are asked; the wording is the library's own, the forms of replies are those that its parsers read.
ANSWER_RULES = "你根据给出的资料回答问题。只写资料里有的事实，不补充数字、日期、人名或条款；用 [1]、[2] 注明出处；资料与问题无关时直接说未找到。先写结论，再写依据。"
ANSWERABILITY_RULES = 'Say whether the question can be answered from the context alone. Reply with JSON only: {"verdict": "ANSWERABLE" or "UNANSWERABLE", "evidence": a literal quotation from the context}.'
REWRITE_RULES = "Write up to three other ways to ask the question, with the terms that a document about it would use. One a line, nothing else."
CRITIC_RULES = "For each numbered passage say whether it helps to answer the question: YES, NO or MAYBE, one a line in the order of the passages, nothing else."
CONTEXT_RULES = "For each numbered passage of the document write one sentence that says where it stands and what it is about. Put a line --- 第N段 --- before the sentence of passage N."
CLAIM_RULES = 'List every fact that the answer states and say whether the passages support it. Reply with JSON only: {"claims": [{"text": ..., "supported": true or false, "evidence": a quotation}], "score": share of supported claims}.'
