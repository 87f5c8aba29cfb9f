from tests.test_workers import run_without_package


def test_operators_run_without_the_package_on_workers(scratch):
    run_without_package("op", scratch)
