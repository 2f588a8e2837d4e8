"""A small contract corpus written for the tests, one document per business type."""

from __future__ import annotations

PARTIES = {
    "purchase": ("甲方（采购方）：海岸机电有限公司", "乙方（供应商）：远山设备有限公司"),
    "sales": ("甲方（供方）：海岸机电有限公司", "乙方（客户）：平川商贸有限公司"),
    "service": ("甲方（委托方）：海岸机电有限公司", "乙方（服务方）：云杉软件有限公司"),
    "labor": ("甲方（用人单位）：海岸机电有限公司", "乙方（劳动者）：王五"),
}

BODIES = {
    "purchase": [
        "合同编号：HT-2026-0001", "{a}", "{b}",
        "统一社会信用代码：91110108MA01ABCD2X", "统一社会信用代码：91320594MA1EFGH3Y7",
        "第一条 标的物", "乙方供应包装线一套。",
        "第二条 合同金额", "合同总金额：人民币 1,250,000.50 元。",
        "第三条 付款方式", "货物到货即付全款，甲方三日内付清。",
        "第四条 验收标准", "甲方在收货后十个工作日内完成验收。",
        "第五条 违约责任", "乙方逾期交货的，应承担甲方全部损失，赔偿责任无上限。",
        "第六条 保密义务", "双方对所知悉的商业秘密负有保密义务。",
        "第七条 争议解决", "因本合同产生的争议，提交香港仲裁。",
        "第八条 知识产权", "本项目产生的知识产权归供应商所有。",
        "第九条 不可抗力", "因不可抗力不能履行的，受影响方应及时告知对方。",
    ],
    "sales": [
        "合同编号：HT-2026-0002", "{a}", "{b}",
        "第一条 产品与数量", "甲方供应终端五百台。",
        "第二条 合同金额", "合同总金额：人民币 800,000.00 元。",
        "第三条 付款方式", "乙方收货后三十日内支付全部款项。",
        "第四条 违约责任",
        "乙方逾期付款的，每日按应付未付金额的万分之一支付滞纳金；甲方逾期交货的，应承担乙方全部损失，赔偿责任无上限。",
        "第五条 保密义务", "双方对所知悉的商业秘密负有保密义务。",
        "第六条 争议解决", "因本合同产生的争议，提交香港仲裁。",
        "第七条 不可抗力", "因不可抗力不能履行的，受影响方应及时告知对方。",
    ],
    "service": [
        "合同编号：HT-2026-0003", "{a}", "{b}",
        "第一条 服务内容", "乙方提供管理系统开发。",
        "第二条 合同金额", "合同总金额：人民币 300,000.00 元。",
        "第三条 付款方式", "签订后五日内，甲方一次性支付全部服务费用。",
        "第四条 服务成果与知识产权", "乙方提供的服务成果及交付物，其所有权归乙方。",
        "第五条 验收标准", "甲方在交付后十个工作日内完成验收。",
        "第六条 违约责任", "甲方逾期付款按万分之一支付滞纳金；乙方逾期交付的，应承担甲方全部损失，赔偿责任无上限。",
        "第七条 保密义务", "双方对所知悉的商业秘密负有保密义务。",
        "第八条 争议解决", "因本合同产生的争议，提交香港仲裁。",
        "第九条 不可抗力", "因不可抗力不能履行的，受影响方应及时告知对方。",
    ],
    "labor": [
        "合同编号：HT-2026-0004", "{a}", "{b}",
        "第一条 试用期", "试用期为三个月，试用期工资为约定工资的 50%。",
        "第二条 劳动报酬", "甲方于每月十日前支付乙方上月工资。",
        "第三条 社会保险", "乙方自愿放弃社会保险，甲方另发社保补贴。",
        "第四条 工作时间", "乙方每周工作六天，甲方不另行支付加班费。",
        "第五条 保密与竞业限制", "乙方离职后两年内不得从事同业竞争。",
        "第六条 违约责任", "乙方提前离职的，应向甲方支付违约金人民币 50000 元。",
    ],
}

DOC_IDS = {kind: i for i, kind in enumerate(BODIES, start=1)}


def lines(kind: str) -> list[str]:
    a, b = PARTIES[kind]
    return [line.format(a=a, b=b) for line in BODIES[kind]]


def chars(text: str) -> list[tuple]:
    """Grid geometry: ten points per character, a row of twelve points per line."""
    out, x, y = [], 0, 0
    for c in text:
        out.append((c, 10.0 * x, 20.0 * y, 10.0 * x + 9.0, 20.0 * y + 12.0))
        x, y = (0, y + 1) if c == "\n" else (x + 1, y)
    return out


def pages(per_page: int = 12, source: str = "native_text") -> list[tuple]:
    rows = []
    for kind, doc_id in DOC_IDS.items():
        body = lines(kind)
        for no, i in enumerate(range(0, len(body), per_page), start=1):
            text = "\n".join(body[i:i + per_page])
            rows.append((doc_id, no, 595.0, 842.0, text, source, 0.93 if source == "ocr" else None, chars(text)))
    return rows
