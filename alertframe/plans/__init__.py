"""alertframe.plans"""
