"""The entry builder on the reference's own hand-made records."""

from gradewell.operators.dataset import build_entries

COLS = ("task_id string, category string, prompt_type string, prompt string, resource_requirements string, "
        "code string, raw_response string, model_short string, sample_num bigint, strategy string, "
        "init_exit int, validate_exit int, plan_exit int, plan_stdout string, plan_stderr string, "
        "apply_exit int, apply_status string, apply_stderr string, spec_passed boolean, iterations int, "
        "generation_time double, expected_failure_matched boolean, post_passed boolean, "
        "vm_details array<struct<name:string,uuid:string,ip:string,status:string,cpus:int,ram_gb:double,disk_gb:double>>, "
        "pre_vm_details array<struct<name:string,uuid:string,ip:string,status:string,cpus:int,ram_gb:double,disk_gb:double>>, "
        "usable_ram_gb double")


def row(**kw):
    base = dict(task_id="C1.1", category="CREATE", prompt_type="detailed", prompt="Create one VM",
                resource_requirements='{"count": 1}', code="", raw_response="", model_short="m", sample_num=1,
                strategy="", init_exit=0, validate_exit=0, plan_exit=0, plan_stdout="Plan: 1 to add",
                plan_stderr="", apply_exit=0, apply_status="success", apply_stderr="", spec_passed=True,
                iterations=1, generation_time=0.0, expected_failure_matched=False, post_passed=None,
                vm_details=[], pre_vm_details=[], usable_ram_gb=None)
    base.update(kw)
    return tuple(base[c.split()[0]] for c in COLS.split(", "))


def entry(spark, **kw):
    return build_entries(spark.createDataFrame([row(**kw)], COLS)).first().entry


def test_plan_only_apply_is_skipped(spark):
    e = entry(spark, task_id="C2.3", resource_requirements=(
        '{"count": 2, "total_memory_max_bytes": 8589934592, "total_cpus": 4, "total_size_bytes": 21474836480}'),
        apply_status="skipped_plan_only", apply_exit=0, plan_stdout="Plan: 2 to add")
    assert e.execution_results.terraform_apply.status == "skipped_plan_only"
    assert e.validation_checklist.execution.terraform_apply_success is False
    assert e.resource_expectations.expected.per_vm_memory_max_bytes == 4294967296
    assert e.resource_expectations.expected.per_vm_cpus == 2
    assert e.final_outcome.plan_success is True and e.final_outcome.apply_success is False
    assert e.execution_results.terraform_plan.resources_to_create == 2


def test_post_state_failure_fails_requirements(spark):
    e = entry(spark, task_id="U1.2", category="UPDATE", resource_requirements='{"count": 1, "target_vm": "app-01"}',
              post_passed=False)
    assert e.final_outcome.execution_successful is True and e.final_outcome.meets_requirements is False


def test_unknown_spec_result_fails_requirements(spark):
    e = entry(spark, spec_passed=None)
    assert (e.final_outcome.plan_success, e.final_outcome.apply_success, e.final_outcome.execution_successful) == (True, True, True)
    assert e.final_outcome.meets_requirements is False
    assert e.final_outcome.resource_allocation_correct is True


def test_entry_id_and_inferred_defaults(spark):
    e = entry(spark, task_id="C1.2", strategy="COT", sample_num=3, prompt="Create a VM with 2 cpu",
              code='resource "xenorchestra_vm" "a" {\n  cpus = 2\n  memory_max = 4294967296\n}')
    assert e.entry_id == "c1_2_m_pass3_COT"
    assert e.llm_response.inferred_defaults.cpus == "2"
    assert e.llm_response.inferred_defaults.ram_bytes == "not_specified"  # multi-digit value missed; no 'ram' in prompt
    assert e.prompt.information_provided == ["cpu"]


def test_update_section_and_edge_case(spark):
    vm = lambda u, cpus, ram: ("app-01", u, "10.0.0.2", "Running", cpus, ram, 20.0)
    e = entry(spark, task_id="U1.2", category="UPDATE", resource_requirements='{"count": 1, "target_vm": "app-01"}',
              pre_vm_details=[vm("u-1", 2, 2.0)], vm_details=[vm("u-1", 4, 4.0)])
    u = e.update_operation_validation
    assert u.uuid_unchanged is True and (u.cpu_before, u.cpu_after) == (2, 4) and u.ram_after_gb == 4.0
    assert e.scenario.available_ram_gb_before == 18.0 and e.metadata.infrastructure_state_before == "1_vms_running"
    assert e.screenshots.terraform_apply_output == "screenshots/u1_2_m_apply.png"
    e = entry(spark, task_id="C5.2", resource_requirements='{"count": 1, "memory_max_bytes": 32212254720, "expected_error": "resource_exhaustion"}',
              expected_failure_matched=True, raw_response="You could use 2 VMs with 8 GB each")
    assert e.edge_case_handling.shortfall_gb == 10.0 and e.edge_case_handling.percentage_over == 50.0
    assert e.edge_case_handling.alternatives_provided == ["2 VMs with 8GB each"]
    assert e.edge_case_score.score_out_of_10 == 10 and e.update_operation_validation is None
