"""Texts of the rules' outcomes."""

# Fixed values: (rule, outcome) -> (message, fix suggestion).
KEEP = "保持当前结构，并继续补一条最强证据。"
TEXTS = {
    ("H1", "no_customer"): ("数据不足：缺少明确的目标客户定义。", "重新定义一个最具体的目标客户画像。"),
    ("H1", "no_value"): ("数据不足：缺少价值主张说明。", "补充一句只服务单一客群的价值主张。"),
    ("H1", "no_channel"): ("数据不足：缺少主渠道策略。", "补充一个当前阶段的主获客渠道。"),
    ("H1", "channel_misfit"): ("渠道与目标客户或价值主张不匹配，商业闭环错位。", "重新选择一个能直接触达目标客户的主渠道。"),
    ("H1", "weak_channel"): ("高客单价或企业采购项目把弱成交渠道当作主渠道。", "将主渠道改成更贴近真实决策链路的成交渠道。"),
    ("H1", "revenue_misfit"): ("收入模式与价值主张不匹配。", "把收入模式改成与核心交付价值一致的付费方式。"),
    ("H1", "ok"): ("未发现明显的客户-价值-渠道-收入错位。", KEEP),
    ("H2", "no_channel"): ("数据不足：缺少渠道说明。", "补充一个当前最主要的获客渠道。"),
    ("H2", "unreachable"): ("选定渠道无法有效覆盖目标客群或场景。", "提供目标用户在该渠道活跃的证据，或立即更换主渠道。"),
    ("H2", "wrong_audience"): ("目标客群与所选渠道的人群分布明显不匹配。", "改用目标客户真实活跃且可转化的渠道。"),
    ("H2", "ok"): ("未发现明确的渠道不可达问题。", KEEP),
    ("H3", "no_pricing"): ("数据不足：尚未给出明确的定价或付费模型。", "补充一个可执行的首版定价模型。"),
    ("H3", "no_payment_evidence"): ("定价模型缺少支付意愿、价格敏感度或真实访谈证据。", "补充一份用户支付意愿或价格敏感度测试记录。"),
    ("H3", "ok"): ("定价模型已有支付意愿相关证据支撑。", KEEP),
    ("H4", "missing"): ("数据不足：缺少市场规模校验所需指标 {missing}。", "补齐 TAM、SAM、SOM 三个数值及各自口径说明。"),
    ("H4", "order"): ("市场规模口径不一致，未满足 TAM >= SAM >= SOM。", "重新核算 TAM、SAM、SOM，确保三者是严格子集关系。"),
    ("H4", "ok"): ("市场规模口径满足 TAM >= SAM >= SOM。", KEEP),
    ("H5", "no_evidence"): ("核心需求描述缺乏访谈、问卷或行为观测证据。", "补充至少 5 份真实用户访谈或行为证据。"),
    ("H5", "weak_evidence"): ("已有证据可信度偏低，仍不足以支撑核心需求判断。", "补充一份带原话摘录的高可信用户证据。"),
    ("H5", "ok"): ("需求描述已有基础用户证据支撑。", KEEP),
    ("H6", "required"): ("项目要求做竞品分析，但当前没有任何结构化竞品材料。", "建立一个包含直接、间接和隐形替代品的竞品矩阵。"),
    ("H6", "denied"): ("项目把“没有竞争对手”当作结论，竞品口径明显失真。", "补充一个真实的替代方案对比矩阵。"),
    ("H6", "one_sided"): ("竞品分析存在口径偏差，缺少直接、间接或隐形替代方案。", "补齐一个包含直接、间接和隐形替代品的对比表。"),
    ("H6", "ok"): ("未发现明显的竞品可比性问题。", KEEP),
    ("H7", "no_claim"): ("当前案例未出现需要验证的强创新宣称。", KEEP),
    ("H7", "unsupported"): ("创新点描述缺乏技术路线、专利状态或量化对比指标支撑。", "补充一页技术路线图或量化对比指标。"),
    ("H7", "ok"): ("创新描述已有基本技术路径或量化指标支撑。", KEEP),
    ("H8", "missing"): ("数据不足：缺少单位经济校验所需指标 {missing}。", "补齐 LTV 和 CAC 两个数值及其计算口径。"),
    ("H8", "cac"): ("数据不足：CAC 小于等于 0，无法判断真实获客成本。", "重新估算 CAC，并纳入投放、人力和渠道成本。"),
    ("H8", "ratio"): ("单位经济不成立，当前 LTV 未达到 3 倍 CAC。", "先把 CAC 降下来或把 LTV 提上去，至少修正其中一个变量。"),
    ("H8", "ok"): ("单位经济满足 LTV >= 3 * CAC。", KEEP),
    ("H9", "no_claim"): ("未检测到激进扩张表述。", KEEP),
    ("H9", "unproven"): ("项目尚未完成 MVP 验证，却直接进入大规模扩张叙述。", "先定义一个单点 MVP 验证里程碑。"),
    ("H9", "ok"): ("增长规划与当前验证程度未发现明显跳跃。", KEEP),
    ("H10", "no_plan"): ("未检测到可判定的里程碑冲突。", KEEP),
    ("H10", "unmanned"): ("技术交付计划偏激进，但团队资源与实现路径说明不足。", "补充一位关键技术负责人或外部资源来源。"),
    ("H10", "ok"): ("里程碑与团队资源未发现明显脱节。", KEEP),
    ("H11", "no_signal"): ("当前案例未检测到强监管或高伦理风险场景。", KEEP),
    ("H11", "no_control"): ("项目涉及 AI、数据隐私或行业准入，但没有任何合规方案说明。", "补充一条数据合规或行业准入路径说明。"),
    ("H11", "ok"): ("已检测到基础合规或准入说明。", KEEP),
    ("H12", "level"): ("技术成熟度目标过高，但团队缺乏匹配的技术专家。", "引入一位能覆盖核心技术路线的外部技术负责人。"),
    ("H12", "no_route"): ("技术路线与现有资源不匹配，当前缺少可执行实现路径。", "把技术方案收敛到团队当前能完成的实现路径。"),
    ("H12", "ok"): ("技术路线与资源未发现明显失配。", KEEP),
    ("H13", "no_claim"): ("当前案例未进入需要严格实验设计的阶段。", KEEP),
    ("H13", "open_loop"): ("MVP 或实验设计缺少任务、指标或证据闭环。", "按“假设-实验-度量-学习”补齐一轮闭环实验。"),
    ("H13", "no_control"): ("实验提法已出现，但缺少对照组或基线说明。", "补充一个对照组或基线方案。"),
    ("H13", "ok"): ("实验设计已具备基础闭环。", KEEP),
    ("H14", "no_project"): ("数据不足：缺少 Project 主节点。", "补充一个 Project 主节点。"),
    ("H14", "gap"): ("路演叙事存在断层，缺少: {missing}。", "先补齐叙事链中最先缺失的一环。"),
    ("H14", "disconnected"): ("问题、方案与增长叙事没有落在同一主线上。", "把断裂最明显的一环连接回 Project 主线。"),
    ("H14", "ok"): ("问题、方案、盈利与增长叙事基本连贯。", KEEP),
    ("H15", "gaps"): ("Rubric 要求的关键证据尚未覆盖完整。", "优先补上传 {missing}。"),
    ("H15", "ok"): ("Rubric 关键证据覆盖完整。", KEEP),
}
GUIDES = {"H1": "用户与价值主张之间还没有完全对齐。", "H4": "市场规模逻辑还需要再推敲一轮。", "H6": "竞品分析还不够扎实。", "H8": "财务假设里还有明显风险。"}
GUIDE_COMPETITORS = "不要默认自己没有对手。请先回答：如果用户不用你的方案，他们现在用什么替代办法解决问题？"
GUIDE_CAC = "CAC 不能默认为 0。请把渠道投放、人力、时间成本一起算进去。"
DISABLED = ("Rule is disabled by admin switch.", "Rule disabled; no action required.")
