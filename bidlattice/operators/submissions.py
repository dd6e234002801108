"""What a requirement asks to be handed in, by the words of its clause (inventory O11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import classify

_REVIEW = "资格审查/投标文件递交时"
#: Branch, whether something must be handed in, when, and what. The first branch that a clause fits counts.
MATERIALS = {
    "package": (True, "投标文件递交时（附件项目管理机构）", "项目管理机构人员资料包：注册资格证书、身份证、职称证、养老保险缴纳证明等原件扫描件，并按文件要求加盖电子印章"),
    "bond": (True, "投标文件递交前", "投标保证金缴纳证明资料（按招标文件允许形式之一：银行转账记录、银行保函、投标保险保单、保证金联保证明、投标承诺书或其他）"),
    "credit": (False, "评审/资格审查时查询", None), "replacement": (True, "投标文件递交时（仅项目经理发生在建更换时）", "项目业主同意项目经理更换的证明"),
    "principals": (True, _REVIEW, "法定代表人、企业经理、企业分管安全生产副经理的安全生产考核合格证书（A证）扫描件"), "manager_b": (True, _REVIEW, "拟派项目经理安全生产考核合格证书（B证）扫描件"),
    "grade": (True, _REVIEW, "建设行政主管部门核发的企业资质证书扫描件"), "mandate": (True, "投标文件递交时", "法定代表人身份证明/授权委托书（按招标文件格式）"),
    "business_license": (True, _REVIEW, "营业执照扫描件/复印件（按文件要求加盖电子印章）"), "safety_license": (True, _REVIEW, "企业安全生产许可证扫描件（按文件要求加盖电子印章）"),
    "safety_officer": (True, _REVIEW, "专职安全生产管理人员有效安全生产考核合格证书（C证）及人员信息"), "manager": (True, _REVIEW, "拟派项目经理注册建造师证书及安全生产考核合格证书（B证）扫描件"),
    "action": (False, "投标执行阶段", None), "other": (False, "资格匹配/准备阶段", None),
}


def submission_branch(assertion: Column, req_type: Column, evidence: Column) -> Column:
    """The branch of MATERIALS that a clause fits; evidence is the array of its evidence kinds. Null text fits by its type only."""
    said = F.coalesce(assertion, F.lit(""))
    asks = lambda kind: F.coalesce(F.array_contains(evidence, kind), F.lit(False))
    has = lambda *words: reduce(lambda a, b: a | b, [said.contains(w) for w in words])
    fits = {
        "package": classify.is_submission_package(said), "bond": has("保证金", "保函") | asks("bid_bond"), "credit": has("失信被执行人", "信用中国") | (has("信用") & has("查询")),
        "replacement": has("项目业主同意更换"), "principals": has("企业主要负责人") & has("安全生产考核合格证书"),
        "manager_b": has("安全生产考核合格证书") & ~has("专职安全生产") & (has("项目经理") | asks("manager_profile")), "grade": has("市政公用工程施工总承包", "建设行政主管部门核发") & ~has("资质"),
        "mandate": has("授权委托") | (has("法定代表人") & has("授权")), "business_license": has("营业执照"), "safety_license": has("安全生产许可证") & has("具备"),
        "safety_officer": has("专职安全生产管理人员") & has("证", "配备"), "manager": has("项目经理") & has("注册", "安全生产考核"), "action": req_type == "action_requirement",
    }
    return F.coalesce(*[F.when(c, name) for name, c in fits.items()], F.lit("other"))


def submission_metadata(assertion: Column, req_type: Column, evidence: Column, stage: Column | None = None) -> Column:
    """struct(branch, required, stage, materials) of a requirement; an action keeps the stage that it states."""
    branch = submission_branch(assertion, req_type, evidence)
    of = lambda i: F.create_map(*[F.lit(x) for name, row in MATERIALS.items() if row[i] is not None for x in (name, row[i])])
    told = F.try_element_at(of(1), branch)
    if stage is not None:
        told = F.when(branch == "action", F.coalesce(stage, told)).otherwise(told)
    return F.struct(branch.alias("branch"), F.try_element_at(of(0), branch).alias("required"), told.alias("stage"), F.try_element_at(of(2), branch).alias("materials"))
